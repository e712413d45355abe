"""The gap between two sets of vectors: Gaussian fits from Gram matrices, Frechet and centroid distances, probe AUC and shared neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import metrics, probes, sampling, vectors
from tallyforge.sources.staging import staged


@dataclass
class Moments:
    """Rows, mean and covariance (sample) of one side; covariance is None under two rows."""

    n: int
    mean: np.ndarray
    cov: np.ndarray | None

    @property
    def spread(self) -> float:
        """Root of the mean squared distance to the mean."""
        return float(np.sqrt(np.trace(self.cov) * (self.n - 1) / self.n)) if self.cov is not None else 0.0


def moments(rows: DataFrame, side: Column, vector: str = "embedding") -> tuple[Moments, Moments]:
    """Of the rows where side doesn't hold, and where it does. Vectors have one length; rows with a null vector or side are left out.

    A partition gives each side's Gram matrix around the common mean as one row for each dimension; these are added up by dimension, so no task has more
    than one line of all partitions' matrices. The driver has the two matrices: 2 d d numbers, whatever the rows.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    own = rows.select(side.alias("side"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("side IS NOT NULL AND v IS NOT NULL")
    if own.isEmpty():
        return Moments(0, np.zeros(0), None), Moments(0, np.zeros(0), None)
    centre = own.select(Summarizer.mean(array_to_vector("v")).alias("m")).first()["m"].toArray()

    def gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for pdf in parts:
            for value, part in pdf.groupby("side"):
                x = np.c_[np.ones(len(part)), np.stack(part["v"].to_numpy()) - centre]
                sums[value] = sums.get(value, 0) + x.T @ x
        for value, s in sums.items():
            yield pd.DataFrame({"side": bool(value), "line": np.arange(len(s)), "sums": [r.tobytes() for r in s]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(sums=[np.add.reduce([np.frombuffer(b) for b in pdf["sums"]]).tobytes()])

    kinds = "side boolean, line int, sums binary"
    lines = own.mapInPandas(gram, kinds).groupBy("side", "line").applyInPandas(add, kinds).collect()  # d + 1 rows for each side
    out = []
    for value in (False, True):
        s = np.stack([np.frombuffer(r["sums"]) for r in sorted((r for r in lines if r["side"] == value), key=lambda r: r["line"])] or [np.zeros(len(centre) + 1)])
        n, mean = round(s[0, 0]), s[0, 1:] / max(1, s[0, 0])
        cov = (s[1:, 1:] - n * np.outer(mean, mean)) / (n - 1) if n > 1 else None
        out.append(Moments(n, centre + mean, cov))
    return out[0], out[1]


def frechet(a: Moments, b: Moments, dims: int = 64) -> float | None:
    """Frechet distance of the Gaussian fits in the first dims principal components of both sides together; None with fewer than two rows of either.

    Components follow from the two sides' moments, so no row is read again.
    """
    if a.cov is None or b.cov is None:
        return None
    n = a.n + b.n
    between = a.mean - b.mean
    whole = ((a.n - 1) * a.cov + (b.n - 1) * b.cov + a.n * b.n / n * np.outer(between, between)) / (n - 1)
    axes = np.linalg.eigh(whole)[1][:, ::-1][:, : min(dims, a.n - 1, b.n - 1, len(whole))]
    c1, c2, m = axes.T @ a.cov @ axes, axes.T @ b.cov @ axes, axes.T @ between
    w, q = np.linalg.eigh(c1)
    root = (q * np.sqrt(np.maximum(w, 0))) @ q.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    return float(m @ m + np.trace(c1) + np.trace(c2) - 2 * cross)


def side_auc(rows: DataFrame, side: Column, key: str, vector: str, k: int = 5, c: float = 0.1, seed: int = 42) -> float | None:
    """Out-of-fold AUC of a balanced probe of the two sides on scaled vectors; None with fewer than k rows of either."""
    data = rows.select(F.col(key).cast("string").alias("g"), side.cast("int").alias("y"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("y IS NOT NULL AND v IS NOT NULL")
    data = staged(vectors.standardised(data, "v").withColumn("c", F.lit("all")), "gap")
    sizes = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < k:
        return None
    folds = staged(sampling.balanced_folds(data, "g", k, "y", ["c"], seed), "gap-folds")
    return metrics.auc(probes.out_of_fold(folds, probes.fitted(folds, k, c)), score="z", label="y").first()["auc"]


def gap_report(rows: DataFrame, side: Column, key: str = "vec_id", label: str | None = "label", vector: str = "embedding", k: int = 10, dims: int = 64, least: int = 20, max_per_class: int | None = 2000, seed: int = 42) -> DataFrame:
    """scope, metric, amount: of all rows (scope all) and of each label with more than `least` rows on both sides (scope label <value>).

    Metrics: n_a, n_b (rows without and with side), domain_auc, centroid_dist (distance of the means over a's spread), frechet, knn_cross (the share of
    a's rows among the k nearest of b's rows, each row's own left out) and knn_cross_chance. With max_per_class each (side, label) is cut
    to that many rows in keyed order, as neighbours are searched among all rows. Labels are few. Building the result runs the jobs.
    """
    own = rows.withColumn("_side", F.coalesce(side, F.lit(False)))
    by = ["_side", *([label] if label else [])]
    if max_per_class:
        own = sampling.placed(own, key, seed, by).where(F.col("place") < max_per_class).drop("place")
    own = staged(own, "gap-rows")
    counts = own.groupBy(*by).agg(F.count("*").alias("n")).collect()  # a row for each side and label
    scopes = [("all", F.lit(True))]
    for value in sorted({r[label] for r in counts if r[label] is not None}) if label else []:
        if all(sum(r["n"] for r in counts if r[label] == value and r["_side"] == s) > least for s in (False, True)):
            scopes.append((f"label {value}", F.col(label) == value))
    out = []
    for scope, where in scopes:
        part = own.where(where)
        a, b = moments(part, F.col("_side"), vector)
        found = {"n_a": a.n, "n_b": b.n}
        if a.n and b.n:
            near = vectors.neighbours(part.where("_side"), part, k, key, key, vector)
            sides = part.select(F.col(key).cast("long").alias("neighbour_id"), "_side")
            cross = near.join(sides, "neighbour_id").agg(F.avg((~F.col("_side")).cast("double")).alias("share")).first()["share"]
            distance = float(np.linalg.norm(a.mean - b.mean) / a.spread) if a.spread else None
            found |= {"domain_auc": side_auc(part, F.col("_side"), key, vector, seed=seed), "centroid_dist": distance, "frechet": frechet(a, b, dims), "knn_cross": cross, "knn_cross_chance": a.n / max(1, a.n + b.n - 1)}
        out += [(scope, name, None if value is None else float(value)) for name, value in found.items()]
    return rows.sparkSession.createDataFrame(out, "scope string, metric string, amount double")
