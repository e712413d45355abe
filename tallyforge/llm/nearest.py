"""Nearest neighbours by cosine: an inverted file whose probed lists are scanned by adaptive sampling of dimensions.

Vectors are scaled to length 1 and turned by a random rotation, so any first columns are a fair sample of all. Centroids come from a
bounded sample; every vector is put in its nearest list. The number of lists that a query probes is set on the sample, against
brute force, so that at least RECALL of the true neighbours are in probed lists. In a list, columns are read in blocks: from the
partial distance over m of d columns the whole is estimated, and a candidate whose estimate is above the k-th best distance
by more than a test's margin is abandoned. Survivors get their exact cosine in double precision on the original vectors.

Lists are cut into chunks by a hash of the id and queries into blocks, so that no list, however hot, is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.shared import read, staged

#: Neighbours; vectors in the fit; share of true neighbours wanted in probed lists; rows of a chunk; queries of a block.
K, SAMPLE, RECALL, CHUNK, QUERIES = 5, 8000, 0.985, 4096, 2048
#: Columns of a block, and the width of the test: a candidate is wrongly abandoned with a chance that falls steeply with it.
COLUMNS, WIDTH = 16, 2.1


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double): vectors that aren't null or zero and hold no null, NaN or infinity, of the most frequent length."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Index:
    """Rotation, centroids and the number of lists to probe; its size is bounded by the number of lists."""

    def __init__(self, sample: np.ndarray, total: int, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        x = unit(sample) @ self.rotation
        lists = int(np.clip(np.sqrt(total) / 2, 1, min(4096, max(1, len(x) // 8))))
        centers = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(12):
            own = (x @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, x)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centers = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centers)
        self.centers = centers
        self.probes = self.calibrate(x, k, rng)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centers.T).argmax(axis=1)

    def calibrate(self, x: np.ndarray, k: int, rng) -> int:
        """The least number of lists in which RECALL of the sample's true neighbours lie, and one more."""
        asked = rng.choice(len(x), min(300, len(x)), replace=False)
        close = x[asked] @ x.T
        close[np.arange(len(asked)), asked] = -2
        best = np.argsort(-close, axis=1)[:, :k]
        rank = np.argsort(np.argsort(-(x[asked] @ self.centers.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, self.lists(x)[best], 1).reshape(-1))
        return min(len(self.centers), int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 2)


def scan(q: np.ndarray, q_id: np.ndarray, q_turned: np.ndarray, v: np.ndarray, v_id: np.ndarray, v_turned: np.ndarray, k: int):
    """(query, vector, score) of each query's k nearest of the chunk, by adaptive scan; a vec_id counts once, by its best score."""
    d = v.shape[1]
    q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    out = []
    rows_of_ids = np.sort(np.unique(v_id, return_index=True)[1])  # a row of each vec_id
    first, repeats = rows_of_ids[: 8 * k], len(rows_of_ids) < len(v_id)
    for i in range(len(q)):
        near = ((v_turned[first] - q_turned[i]) ** 2).sum(axis=1)[v_id[first] != q_id[i]]
        bound = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
        left, partial = np.arange(len(v)), np.zeros(len(v))
        for m in range(0, d, COLUMNS):
            block = v_turned[left, m : m + COLUMNS] - q_turned[i, m : m + COLUMNS]
            partial = partial + (block * block).sum(axis=1)
            seen = min(d, m + COLUMNS)
            if np.isfinite(bound):
                # all columns seen: the exact distance, less what rounding may add
                limit = bound * (1 + WIDTH / np.sqrt(seen)) ** 2 * seen / d if seen < d else bound * (1 + 1e-9) + 1e-12
                keep = partial <= limit
                left, partial = left[keep], partial[keep]
        left = left[v_id[left] != q_id[i]]
        score = (v[left] * q[i]).sum(axis=1) / (v_norm[left] * q_norm[i])
        best = np.lexsort((v_id[left], -score))
        if repeats:
            best = best[np.sort(np.unique(v_id[left][best], return_index=True)[1])]
        best = best[:k]
        out.append((np.full(len(best), q_id[i]), v_id[left][best], score[best]))
    return [np.concatenate(x) if x else np.zeros(0) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 3


def search(table: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each usable row where is_query holds (a condition on vec_id) its k nearest other rows.

    Ties go to the smaller vec_id. A repeated vec_id counts once, by its best score; rows with the query's own id are never its
    candidates. With fewer than k candidates all are returned. Unusable vectors take no part. An empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = staged(usable(table, id_col, vector_col).distinct(), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < float(1 << 20) * min(1.0, SAMPLE / total)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE).toArrow()
    x = np.array(sample.column("v").to_pylist(), float) if len(sample) else np.array(rows.limit(1).toArrow().column("v").to_pylist(), float)
    shared = spark.sparkContext.broadcast(Index(x, total, k))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=shared.value.lists(unit(np.stack(pdf["v"].to_numpy())) @ shared.value.rotation).astype("int32"))

    placed = staged(rows.mapInPandas(place, "vec_id long, v array<double>, list int"), "lists")
    per_id = placed.groupBy("list", "vec_id").agg(F.count("*").alias("n"))
    counts = {r["list"]: (r["ids"], r["n"]) for r in per_id.groupBy("list").agg(F.count("*").alias("ids"), F.sum("n").alias("n")).collect()}  # a row per list
    sizes, n_rows = np.array([counts.get(i, (0, 0)) for i in range(len(shared.value.centers))]).T
    chunks = np.maximum(1, -(-n_rows // CHUNK))

    def ask(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            turned = unit(np.stack(pdf["v"].to_numpy())) @ shared.value.rotation
            order = np.argsort(-(turned @ shared.value.centers.T), axis=1, kind="stable")
            # at least the probes, and as many more as it takes to see 10 k vec_ids
            enough = (np.cumsum(sizes[order], axis=1) - sizes[order]) < 10 * k
            enough[:, : shared.value.probes] = True
            for vec_id, v, lists, use in zip(pdf["vec_id"], pdf["v"], order, enough, strict=True):
                own = lists[use & (sizes[lists] > 0)]
                chunk = [(int(a), c) for a in own for c in range(chunks[a])]
                yield pd.DataFrame({"vec_id": vec_id, "v": [v] * len(chunk), "list": [a for a, _ in chunk], "chunk": [c for _, c in chunk]})

    queries = placed.where(is_query).select("vec_id", "v")
    n_queries = queries.count()
    parts = max(1, -(-n_queries * shared.value.probes // (len(sizes) * QUERIES)))
    asked = queries.mapInPandas(ask, "vec_id long, v array<double>, list int, chunk int").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts)))
    per_list = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("list") + 1)
    cut = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), per_list).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        a, b, r = np.stack(q["v"].to_numpy()), np.stack(v["v"].to_numpy()), shared.value.rotation
        found = scan(a, q["vec_id"].to_numpy(), unit(a) @ r, b, v["vec_id"].to_numpy(), unit(b) @ r, k)
        return pd.DataFrame({"query_id": found[0].astype("int64"), "vec_id": found[1].astype("int64"), "score": found[2].astype("float64")})

    keys = ["list", "chunk", "part"]
    near = asked.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
