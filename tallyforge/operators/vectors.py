"""Neighbours, coverage and domain analytics over embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.staging import staged

#: A table of up to BLOCK rows is one block; a pivot stands for PER_PIVOT rows; TOGETHER rows and VALUES numbers of vectors of either side meet in
#: one task at most, which holds matrices of CELLS numbers.
BLOCK, PER_PIVOT, TOGETHER, VALUES, CELLS = 4000, 1000, 32_768, 1 << 21, 1 << 19


def stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def nearest_in(a: pd.DataFrame, b: pd.DataFrame, k: int, wanted: np.ndarray | None = None) -> pd.DataFrame:
    """query_id, neighbour_id, distance: the k nearest rows of b in other groups for each row of a (id, g, v); ties to the smaller id.

    With a column bound in a, only rows of b as near as that. With wanted (rows of a x slices), b has a column slice, and a row of a meets the slices that it
    wants. Products of centred vectors in single precision rule rows out, a matrix of CELLS numbers at a time; where they leave much, or can't hold the
    numbers, double precision does. What is left is summed term by term.
    """
    b = b if wanted is not None else b.assign(slice=0)
    b = b.sort_values("id")
    same = b["v"].map(lambda v: (v + 0.0).tobytes())
    if same.duplicated().any():
        # of equal vectors only those that can be among the k: the k least ids of each group, and of these the 2 k least
        b = b[b.groupby([same, b["g"]], sort=False, dropna=False).cumcount() < k]
        b = b[b.groupby(same.loc[b.index], sort=False).cumcount() < 2 * k]
    del same
    b = b.sort_values("slice", kind="stable")
    out = []
    if len(a) and len(b):
        codes = pd.factorize(pd.concat([a["g"], b["g"]], ignore_index=True))[0]
        ga, gb, b_ids, xb, cut = codes[: len(a)], codes[len(a) :], b["id"].to_numpy(), stacked(b["v"]), b["slice"].to_numpy()
        middle = xb.mean(0)
        middle = np.where(np.isfinite(middle), middle, 0)
        rows = max(1, min(512, CELLS // 512))
        columns = max(k, CELLS // rows)
        edges = [(lo, min(lo + columns, len(xb))) for lo in range(0, len(xb), columns)]
        bb = np.concatenate([((xb[lo:hi] - middle) ** 2).sum(1) for lo, hi in edges])
        largest = np.where(np.isfinite(bb), bb, 0).max()
        tile = lambda lo, hi, kind: np.c_[xb[lo:hi] - middle, bb[lo:hi]].astype(kind, copy=False).T
        single = np.isfinite(bb).all() and 1e-20 < largest < 1e30  # so that neither products nor their rounding leave float32
        tiles = [tile(lo, hi, np.float32) for lo, hi in edges] if single else None
        room = {kind: 16 * (xb.shape[1] + 4) * float(np.finfo(kind).eps) for kind in (np.float32, np.float64)}  # the products' rounding
        bound = a["bound"].fillna(np.inf).to_numpy(float) if "bound" in a else np.full(len(a), np.inf)
        for at in range(0, len(a), rows):
            own = a.iloc[at : at + rows]
            xa, ids = stacked(own["v"]), own["id"].to_numpy()
            aa = ((xa - middle) ** 2).sum(1)
            asked = np.c_[-2 * (xa - middle), np.ones(len(xa))]
            kinds = [np.float32, np.float64] if single and aa.max() < 1e30 else [np.float64]
            asks = {kind: asked.astype(kind) for kind in kinds}
            most = bound[at : at + rows] ** 2 * (1 + 8 * np.finfo(float).eps)  # a bound is a rounded root
            best, best_ids = np.full((len(xa), k), np.inf), np.full((len(xa), k), np.iinfo(np.int64).max)
            for i, (lo, hi) in enumerate(edges):
                use, whole = np.arange(len(xa)), True
                if wanted is not None:
                    asking = wanted[at : at + rows, cut[lo] : cut[hi - 1] + 1]
                    use, whole = np.flatnonzero(asking.any(1)), bool(asking.all())
                if not len(use):
                    continue
                for kind in kinds:
                    rough = (asks[kind] if len(use) == len(xa) else asks[kind][use]) @ (tiles[i] if kind == np.float32 else tile(lo, hi, kind))
                    limit = np.minimum(most, best[:, -1])[use] - aa[use]
                    free = np.flatnonzero(np.isinf(limit))
                    if len(free) and hi - lo >= k:
                        others = rough[free]
                        others[ga[at + use[free]][:, None] == gb[None, lo:hi]] = np.nan
                        if not whole:
                            others[~wanted[at + use[free]][:, cut[lo:hi]]] = np.nan
                        kth = np.partition(others, k - 1, axis=1)[:, k - 1].astype(float)
                        limit[free] = np.where(np.isnan(kth), np.inf, kth)
                    limit += room[kind] * (aa[use] + largest)
                    hits = np.flatnonzero(rough <= np.minimum(limit, np.finfo(kind).max).astype(kind)[:, None])
                    if len(hits) <= rough.size // 8:
                        break
                r, c = np.divmod(hits, hi - lo)
                r, c = use[r], lo + c
                other = ga[at + r] != gb[c]
                if not whole:
                    other &= wanted[at + r, cut[c]]
                r, c = r[other], c[other]
                step = max(1, CELLS // xb.shape[1])
                d = np.concatenate([((xb[c[j : j + step]] - xa[r[j : j + step]]) ** 2).sum(1) for j in range(0, len(r), step)] or [np.empty(0)])
                nearer = d <= np.minimum(most, best[:, -1])[r]
                r, c, d = r[nearer], c[nearer], d[nearer]
                if not len(r):
                    continue
                touched = np.unique(r)
                r = np.r_[r, np.repeat(touched, k)]
                d, found = np.r_[d, best[touched].ravel()], np.r_[b_ids[c], best_ids[touched].ravel()]
                order = np.lexsort((found, d, r))
                r, d, found = r[order], d[order], found[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                kept = rank < k
                best[r[kept], rank[kept]], best_ids[r[kept], rank[kept]] = d[kept], found[kept]
            full = np.isfinite(best)
            out.append(pd.DataFrame({"query_id": np.repeat(ids, full.sum(1)), "neighbour_id": best_ids[full], "distance": np.sqrt(best[full])}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "neighbour_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})


def runs(n: np.ndarray, least: int) -> np.ndarray:
    """Numbers of runs of consecutive places; a run ends once it has `least` rows."""
    out, run, rows = [], 0, 0
    for size in n:
        out.append(run)
        rows += size
        if rows >= least:
            run, rows = run + 1, 0
    return np.array(out, int)


class Blocks:
    """The blocks of one class of index rows, neighbouring pivots side by side: sizes, least and largest distances, slices of about per_slice rows and shelves of about per_shelf."""

    def __init__(self, pivot: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, per_slice: int, per_shelf: int):
        self.pivot, self.n, self.low, self.high = pivot, n, low, high
        self.slice = runs(n, per_slice)
        self.slice_at = np.unique(self.slice, return_index=True)[1]
        self.slice_rows = np.add.reduceat(n, self.slice_at)
        self.shelf = runs(self.slice_rows, per_shelf)  # of each slice
        self.shelf_at = np.unique(self.shelf, return_index=True)[1]
        self.shelf_rows = np.add.reduceat(self.slice_rows, self.shelf_at)

    def nearest(self, d: np.ndarray, enough: int) -> np.ndarray:
        """rows x slices: those of the nearest blocks with `enough` rows together."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < enough, axis=1)
        return np.logical_or.reduceat(out, self.slice_at, axis=1)

    def possible(self, d: np.ndarray, bound: np.ndarray, scale: np.ndarray, at: int, end: int) -> np.ndarray:
        """rows x slices (from at to end): those that may hold a row as near as bound, by the triangle inequality, with room for rounding. d: of their blocks."""
        first = self.slice_at[at]
        own = slice(first, first + d.shape[1])
        least = np.maximum(d - self.high[own], self.low[own] - d) - 1e-6 * (1 + d + scale[:, None])
        return np.logical_or.reduceat(~(least > bound[:, None]), self.slice_at[at:end] - first, axis=1)

    def visited(self, need: np.ndarray) -> dict:
        """shelves and pairs of rows that meet slices."""
        return {"shelves": lists_of(np.logical_or.reduceat(need, self.shelf_at, axis=1)), "pairs": (need * self.slice_rows).sum(1)}


class Pivots:
    """Rows of the index that stand for blocks of the rows nearest to them; and the blocks of each class."""

    def __init__(self, index: DataFrame, rows: int, per_pivot: int):
        m = max(1, per_pivot if rows > per_pivot else rows)
        found = index.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(m)) == 0).select("v").collect() if rows > per_pivot else []  # one of per_pivot rows
        found = found or index.select("v").limit(1).collect()
        self.at = np.unique(np.array([r["v"] for r in found], float), axis=0)
        self.blocks: dict[int, Blocks] = {}

    def distances(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = self.at if at is None else self.at[at]
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (at * at).sum(1)[None, :] - 2 * x @ at.T))

    def pieces(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows by class, few enough at a time for a matrix of their distances to all pivots."""
        step = max(1, CELLS // len(self.at))
        for pdf in parts:
            for _, own in pdf.groupby("c"):
                for i in range(0, len(own), step):
                    yield own.iloc[i : i + step]

    def homed(self, rows: DataFrame) -> DataFrame:
        """rows (id, g, v, c) with home, the nearest pivot's number, and r, the distance to it."""

        def home(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in self.pieces(parts):
                d = self.distances(stacked(pdf["v"]))
                yield pdf.assign(home=d.argmin(1), r=d.min(1))

        return rows.mapInPandas(home, f"{kinds(rows)}, home int, r double")

    def measured(self, homed: DataFrame, per_slice: int, per_shelf: int) -> None:
        found = homed.groupBy("c", "home").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()  # a row for each pivot and class
        place = np.empty(len(self.at), int)
        place[self.order(np.arange(len(self.at)))] = np.arange(len(self.at))
        by_class: dict[int, list] = {}
        for r in found:
            by_class.setdefault(r["c"], []).append((place[r["home"]], r["home"], r["n"], r["low"], r["high"]))
        for c, rows in by_class.items():
            _, pivot, n, low, high = map(np.array, zip(*sorted(rows), strict=True))
            self.blocks[c] = Blocks(pivot, n, low, high, per_slice, per_shelf)

    def order(self, own: np.ndarray) -> np.ndarray:
        """Pivots halved by the dimension in which they differ most, again and again: neighbours stand side by side."""
        if len(own) < 3:
            return own
        own = own[np.argsort(self.at[own, self.at[own].var(0).argmax()], kind="stable")]
        return np.concatenate([self.order(own[: len(own) // 2]), self.order(own[len(own) // 2 :])])


def kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def lists_of(flags: np.ndarray) -> list[np.ndarray]:
    """For each row the numbers of the columns that are true."""
    row, column = np.nonzero(flags)
    return np.split(column.astype(np.int32), np.cumsum(np.bincount(row, minlength=len(flags)))[:-1])


def visits(queries: DataFrame, pivots: Pivots, enough: int) -> DataFrame:
    """queries (id, g, v, c) with seen (slices), shelves and pairs: the slices of the nearest blocks with `enough` rows together, their shelves, and the rows met there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pivots.pieces(parts):
            b = pivots.blocks.get(pdf["c"].iloc[0])
            if b is not None:
                need = b.nearest(pivots.distances(stacked(pdf["v"]), b.pivot), enough)
                yield pdf.assign(seen=lists_of(need), **b.visited(need))

    return queries.mapInPandas(run, f"{kinds(queries)}, seen array<int>, shelves array<int>, pairs long")


def wanted_of(pdf: pd.DataFrame, pivots: Pivots, b: Blocks, at: int, end: int, first: bool) -> np.ndarray:
    """rows x slices (from at to end): those in seen (first), or all others that may hold a row as near as bound."""
    seen = np.zeros((len(pdf), len(b.slice_at)), bool)
    seen[np.repeat(np.arange(len(pdf)), pdf["seen"].map(len)), np.concatenate(pdf["seen"].to_list()).astype(int)] = True
    if first:
        return seen[:, at:end]
    x, own = stacked(pdf["v"]), b.pivot[(b.slice >= at) & (b.slice < end)]
    return b.possible(pivots.distances(x, own), pdf["bound"].fillna(np.inf).to_numpy(float), np.abs(x).max(1), at, end) & ~seen[:, at:end]


def others(asked: DataFrame, pivots: Pivots) -> DataFrame:
    """asked (visits with bound: the distance to beat, or null) with the shelves and pairs of all other slices that may hold a row as near."""
    rows = asked.drop("shelves", "pairs")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pivots.pieces(parts):
            b = pivots.blocks[pdf["c"].iloc[0]]
            yield pdf.assign(**b.visited(wanted_of(pdf, pivots, b, 0, len(b.slice_at), False)))

    return rows.mapInPandas(run, f"{kinds(rows)}, shelves array<int>, pairs long")


def searched(q: DataFrame, x: DataFrame, k: int, total: int, per_pivot: int, compared: list | None) -> DataFrame:
    """query_id, c, rank, neighbour_id, distance: the k nearest rows of x (id, g, v, c) in other groups among those of each query's class c. x has rows."""
    # a table of about a block is one block: there is nothing to rule out
    pivots = Pivots(x, total, total if total <= min(BLOCK, 4 * per_pivot) else per_pivot)
    together = max(1, min(TOGETHER, VALUES // max(1, pivots.at.shape[1]), max(PER_PIVOT, total // 8)))
    homed = staged(pivots.homed(x), "homed")
    pivots.measured(homed, -(-per_pivot // 4), together)
    places = [(c, int(home), int(s), int(b.shelf[s]), -(-int(b.shelf_rows[b.shelf[s]]) // (2 * together))) for c, b in pivots.blocks.items() for home, s in zip(b.pivot, b.slice, strict=True)]
    places = x.sparkSession.createDataFrame(places, "c int, home int, slice int, shelf int, subs int")  # a row for each pivot and class
    shelved = homed.drop("r").join(F.broadcast(places), ["c", "home"]).withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int")).drop("home", "subs")
    subs = places.select("c", "shelf", "subs").distinct()

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id", "c").orderBy("distance", "neighbour_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def meeting(asked: DataFrame, first: bool) -> DataFrame:
        """The k nearest of each query in each shelf that it visits: part by part of the shelf's queries and rows."""
        each = asked.select("id", "g", "v", "c", "seen", *([] if first else ["bound"]), F.explode("shelves").alias("shelf"))
        parts = each.groupBy("c", "shelf").agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))  # a row for each shelf
        spread = lambda t, n, name: t.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
        dealt = each.join(F.broadcast(parts), ["c", "shelf"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int")).drop("parts")
        dealt = spread(dealt.join(F.broadcast(subs), ["c", "shelf"]), "subs", "sub")
        copies = spread(shelved.join(F.broadcast(parts), ["c", "shelf"]), "parts", "part")

        def meet(a: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(rows):
                return nearest_in(a, rows, k).assign(c=0)
            c, shelf = int(a["c"].iloc[0]), int(a["shelf"].iloc[0])
            b = pivots.blocks[c]
            at, end = np.searchsorted(b.shelf, [shelf, shelf + 1])
            step = max(1, CELLS // len(b.pivot))
            wanted = np.concatenate([wanted_of(a.iloc[i : i + step], pivots, b, at, end, first) for i in range(0, len(a), step)])
            return nearest_in(a, rows.assign(slice=rows["slice"] - at), k, wanted).assign(c=c)

        on = ["c", "shelf", "sub", "part"]
        met = dealt.groupBy(*on).cogroup(copies.groupBy(*on)).applyInPandas(meet, "query_id long, neighbour_id long, distance double, c int")
        return staged(met, "met")

    asked = staged(visits(q, pivots, 4 * k), "asked")
    found = meeting(asked, True)
    asks = [asked]
    if any(len(b.slice_at) > 1 for b in pivots.blocks.values()):
        bounds = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "c", F.col("distance").alias("bound"))
        asks.append(staged(others(asked.join(bounds, ["id", "c"], "left"), pivots), "asked"))
        found = found.unionByName(meeting(asks[1], False))
    if compared is not None:
        compared[:] = [sum(t.agg(F.sum("pairs").alias("n")).first()["n"] or 0 for t in asks), q.count() * total]
    return best(found)


def plain_rows(rows: DataFrame, id_col: str, group: str, vector: str, *more: Column) -> DataFrame:
    """id, g, v, ...: vectors of single precision stay so on the way."""
    kind = "float" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.transform(vector, lambda x: x.cast(kind)).alias("v"), *more)


def neighbours(queries: DataFrame, index: DataFrame, k: int, id_col: str = "vec_id", group: str = "grp", vector: str = "embedding", n_index: int | None = None, per_pivot: int = PER_PIVOT, compared: list | None = None) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k nearest index rows of other groups, exactly; ties to the smaller id. Ids are distinct.

    Index rows stand in blocks around pivots, a sample of one row in per_pivot; neighbouring blocks are a shelf. A query meets its nearest blocks first;
    its k-th distance there and the triangle inequality then rule out blocks that can't hold a nearer row, and it meets the rest, shelf by shelf. At most
    TOGETHER queries meet about as many rows in one task, so a query is copied once for each shelf and a row once for each TOGETHER queries. How
    much is ruled out depends on the vectors: clustered ones leave little, high-dimensional noise nearly all, and the work is quadratic then.
    compared, if given, gets the numbers of pairs that were compared and that there are. Building the result runs the jobs.
    """
    x, q = (staged(plain_rows(t, id_col, group, vector, F.lit(0).alias("c")), name) for t, name in ((index, "index"), (queries, "queries")))
    total = n_index or x.count()
    if not total:
        return q.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("distance")).limit(0)
    return searched(q, x, k, total, per_pivot, compared).select("query_id", "rank", "neighbour_id", "distance")


def neighbours_by(queries: DataFrame, index: DataFrame, by: str, k: int, within: str | None = None, vector: str = "embedding", id_col: str = "vec_id", group: str = "grp") -> DataFrame:
    """query_id, by, neighbour_id, distance: the k nearest index rows of other groups in each value of by (and, with within, of the query's value of it).

    From these lists the k nearest of any choice of values follow exactly, without another search. The values (domains) are few; all are searched at once.
    """
    values = sorted(tuple(r) for r in index.select(by, *([within] if within else [])).distinct().collect())
    none = F.lit(None).cast(index.schema[by].dataType)
    if not values:
        return queries.select(F.col(id_col).cast("long").alias("query_id"), none.alias(by), F.col(id_col).cast("long").alias("neighbour_id"), F.lit(0.0).alias("distance")).limit(0)
    is_of = lambda v: (F.col(by) == v[0]) & (F.col(within) == v[1] if within else F.lit(True))
    asks = F.array_compact(F.array(*[F.when(F.col(within) == v[1] if within else F.lit(True), i) for i, v in enumerate(values)]))
    x = staged(plain_rows(index, id_col, group, vector, F.coalesce(*[F.when(is_of(v), i) for i, v in enumerate(values)]).alias("c")), "index")
    q = staged(plain_rows(queries, id_col, group, vector, F.explode(asks).alias("c")), "queries")
    names = F.coalesce(*[F.when(F.col("c") == i, F.lit(v[0])) for i, v in enumerate(values)], none)
    return searched(q, x, k, x.count(), PER_PIVOT, None).select("query_id", names.alias(by), "neighbour_id", "distance")


def coverage_of(lists: DataFrame, choices: DataFrame, sizes: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """choice, query_id, label, coverage for each choice of pool domains.

    lists: query_id, domain, neighbour_id, distance (domain null: production). choices: choice, domain (its pool). sizes: label, domain, n (domain null:
    production). labels: query_id, label. Coverage is the pool's share of the k nearest of production and pool, over its chance share.
    """
    everything = choices.select("choice").distinct()
    pools = choices.withColumn("pool", F.lit(True)).unionByName(everything.select("choice", F.lit(None).cast("string").alias("domain"), F.lit(False).alias("pool")))
    pools = pools.withColumnRenamed("domain", "_d")
    mine = lists.join(F.broadcast(pools), F.col("domain").eqNullSafe(F.col("_d"))).drop("_d")  # a row per choice and domain: small
    rank = F.row_number().over(W.partitionBy("choice", "query_id").orderBy("distance", "neighbour_id"))
    share = mine.withColumn("_n", rank).where(F.col("_n") <= k).groupBy("choice", "query_id").agg(F.avg(F.col("pool").cast("double")).alias("share")).join(labels, "query_id")
    totals = sizes.join(pools, F.col("domain").eqNullSafe(F.col("_d"))).groupBy("choice", "label").agg(F.sum(F.when(F.col("pool"), F.col("n")).otherwise(0)).alias("_pool"), F.sum("n").alias("_all"))
    chance = F.when(F.col("_pool") > 0, F.col("_pool") / (F.col("_all") - 1)).otherwise(1.0)
    return share.join(totals, ["choice", "label"]).select("choice", "query_id", "label", (F.col("share") / chance).alias("coverage"))


def coverage(near: DataFrame, is_pool: DataFrame, n_pool: int, n_prod: int) -> DataFrame:
    """query_id, coverage: the pool's share of a production row's neighbours over its chance share. is_pool: neighbour_id, pool (boolean)."""
    chance = n_pool / (n_pool + n_prod - 1) if n_pool else 1.0
    share = F.avg(F.col("pool").cast("double"))
    return near.join(is_pool, "neighbour_id").groupBy("query_id").agg((share / chance).alias("coverage"))


def lift(near: DataFrame, cells: DataFrame, cell: Sequence[str]) -> DataFrame:
    """cell, n, hits, lift: a pool cell's share of the neighbours over its share of the pool, within each value of cell's columns but the first.

    cells: neighbour_id and the cell columns, for all of the pool.
    """
    hits = near.join(cells, "neighbour_id").groupBy(*cell).agg(F.count("*").alias("hits"))
    n = cells.groupBy(*cell).agg(F.count("*").alias("n")).join(hits, list(cell), "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    everything = W.partitionBy(*cell[1:]) if len(cell) > 1 else W.partitionBy(F.lit(0))
    return n.withColumn("lift", (F.col("hits") / F.sum("hits").over(everything)) / (F.col("n") / F.sum("n").over(everything)))


def nearest_value(near: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """query_id, value: the most frequent among its neighbours, ties by value."""
    n = near.join(values, "neighbour_id").groupBy("query_id", value).agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))


def affinity(near: DataFrame, cells: DataFrame) -> DataFrame:
    """src, dst, count, log_lift over all pairs of cells: log2((count + 1) / (expected + 1)). cells: id, cell; the grid of cells is small."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
    pairs = near.join(cells.select(F.col("id").alias("query_id"), F.col("cell").alias("src")), "query_id").join(cells.select(F.col("id").alias("neighbour_id"), F.col("cell").alias("dst")), "neighbour_id")
    n = pairs.groupBy("src", "dst").agg(F.count("*").alias("count"))
    names = sizes.agg(F.collect_list(F.struct("cell", "size")).alias("all"), F.sum("size").alias("total"))
    grid = names.select("total", F.explode("all").alias("a"), "all").select("total", F.col("a.cell").alias("src"), F.explode("all").alias("b")).select("total", "src", F.col("b.cell").alias("dst"), F.col("b.size").alias("size"))
    j = grid.join(n, ["src", "dst"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    expected = F.sum("count").over(W.partitionBy("src")) * F.col("size") / F.col("total")
    return j.select("src", "dst", "count", F.log2((F.col("count") + 1) / (expected + 1)).alias("log_lift"))


def affinity_distance(table: DataFrame) -> DataFrame:
    """a, b, distance: 1 - correlation of two cells' rows of the symmetrised affinity (src, dst, log_lift)."""
    back = table.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("log_lift").alias("_b"))
    sym = table.join(back, ["src", "dst"]).select("src", "dst", ((F.col("log_lift") + F.col("_b")) / 2).alias("x"))
    other = sym.select(F.col("src").alias("b"), "dst", F.col("x").alias("y"))
    return sym.withColumnRenamed("src", "a").join(other, "dst").where("a < b").groupBy("a", "b").agg((1 - F.corr("x", "y")).alias("distance"))


def centroid_distance(rows: DataFrame, side: Column, vector: str = "embedding") -> DataFrame:
    """distance of the two sides' means in units of their mean within-spread."""
    each = rows.select(side.alias("side"), F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x"))
    s = each.groupBy("p").agg(*[f(F.when(F.col("side") == v, F.col("x"))).alias(f"{n}{int(v)}") for v in (True, False) for f, n in ((F.avg, "m"), (F.var_pop, "v"))])
    gap = F.sqrt(F.sum((F.col("m1") - F.col("m0")) ** 2))
    spread = (F.sqrt(F.sum("v1")) + F.sqrt(F.sum("v0"))) / 2
    return s.agg((gap / spread).alias("distance"))


def centred_pca(rows: DataFrame, fit_on: DataFrame, k: int, vector: str = "embedding", out: str = "z") -> tuple[DataFrame, float]:
    """rows with z, the first k principal components (array, unit length) of a model fitted on a bounded subset; and the explained share."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    raw = lambda t: t.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(raw(fit_on))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(raw(fit_on)))
    p = vector_to_array("_p")
    norm = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x))
    done = model.transform(centre.transform(raw(rows))).withColumn(out, F.transform(p, lambda x: x / F.greatest(norm, F.lit(1e-12))))
    return done.drop("_v", "_c", "_p"), float(sum(model.explainedVariance))


def standardised(rows: DataFrame, vector: str) -> DataFrame:
    """rows with the vector's columns at mean 0 and deviation 1 over all rows; constant columns become 0."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    raw = rows.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    done = StandardScaler(withMean=True, inputCol="_x", outputCol="_s").fit(raw).transform(raw)
    return done.withColumn(vector, vector_to_array("_s")).drop("_x", "_s")


def transfer(train: DataFrame, test: DataFrame, label: str, vector: str, reg: float = 0.01) -> DataFrame:
    """test rows with probability by a probe fitted on train."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = lambda t: t.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, maxIter=20).fit(data(train))
    return model.transform(data(test)).withColumn("_p1", F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "prediction", "probability").withColumnRenamed("_p1", "probability")


def odds_weights(rows: DataFrame, probability: str = "probability", low: float = 0.1, high: float = 10.0) -> DataFrame:
    """rows with weight: odds over their median, held to [low, high]."""
    odds = F.col(probability) / F.greatest(1 - F.col(probability), F.lit(1e-9))
    o = rows.withColumn("_o", odds)
    middle = o.agg(F.percentile("_o", 0.5))
    return o.withColumn("_m", middle.scalar()).withColumn("weight", F.least(F.lit(high), F.greatest(F.lit(low), F.col("_o") / F.col("_m")))).drop("_o", "_m")


def kmeans(rows: DataFrame, k: int, vector: str, seed: int = 42) -> DataFrame:
    """rows with cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, featuresCol="_x", predictionCol="cluster", seed=seed).fit(data).transform(data).drop("_x")


def region_profile(rows: DataFrame, cluster: str, prod: Column, low: float = 0.2) -> DataFrame:
    """cluster, n, n_prod, status: pool_only without production rows, production_gap where they are over 1 - low, else shared."""
    g = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(prod).alias("n_prod"))
    return g.withColumn("status", F.when(F.col("n_prod") == 0, "pool_only").when(F.col("n_prod") > (1 - low) * F.col("n"), "production_gap").otherwise("shared"))


def closest_members(rows: DataFrame, cluster: str, side: str, vector: str, k: int, id_col: str = "vec_id") -> DataFrame:
    """cluster, side, rank, id, distance: the k rows nearest their cluster's mean, for each side."""
    mean = rows.select(cluster, F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x")).groupBy(cluster, "p").agg(F.avg("x").alias("m")).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("_m"))
    d = F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    j = rows.join(mean, cluster).withColumn("distance", d)
    return j.withColumn("rank", F.row_number().over(W.partitionBy(cluster, side).orderBy("distance", id_col))).where(F.col("rank") <= k).select(cluster, side, "rank", id_col, "distance")


def unit_range(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1] over all rows."""
    ends = rows.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])
    for c in columns:
        rows = rows.withColumn("_e", ends.select(c).scalar()).withColumn(c, (F.col(c) - F.col("_e.lo")) / F.greatest(F.col("_e.hi") - F.col("_e.lo"), F.lit(1e-9))).drop("_e")
    return rows
