"""Sampling, splitting and allocation in keyed random order: the same rows under any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.keyed import gumbel, shuffle_key, uniform
from tallyforge.sources.staging import staged


#: Rows that a task ranks, about; the number of buckets follows from it.
PER_BUCKET = 100_000


def placed(rows: DataFrame, key: str, seed: int | str = 42, by: Sequence[str] = (), per_bucket: int | None = None) -> DataFrame:
    """rows with place: 0, 1, ... in keyed random order within each value of by (or over all rows).

    Rows are ranked inside buckets of the order's leading digits, as many as the rows need, and lifted by the earlier buckets' counts, so no
    task ranks all rows or all rows of a group.
    """
    digits = max(1, math.ceil(math.log(max(1, rows.count() / (per_bucket or PER_BUCKET)), 16)))
    rows = rows.withColumn("_o", shuffle_key(seed, F.col(key))).withColumn("_k", F.substring("_o", 1, digits))
    counts = rows.groupBy(*by, "_k").agg(F.count("*").alias("_n"))
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    lifts = counts.select(*by, "_k", F.coalesce(F.sum("_n").over(own.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_lift"))
    inside = F.row_number().over(W.partitionBy(*by, "_k").orderBy("_o", key)) - 1
    return rows.withColumn("_i", inside).join(lifts, [*by, "_k"]).withColumn("place", (F.col("_i") + F.col("_lift")).cast("long")).drop("_o", "_k", "_i", "_lift")


def capped(rows: DataFrame, by: Sequence[str], cap: int, key: str, seed: int | str = 42) -> DataFrame:
    """At most cap rows of each group, in keyed random order."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(shuffle_key(seed, F.col(key)), key))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def first(rows: DataFrame, n: int, key: str, seed: int | str = 42) -> DataFrame:
    """n rows in keyed random order."""
    return rows.orderBy(shuffle_key(seed, F.col(key)), key).limit(n)


def keep_first(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def cell_sample(rows: DataFrame, cell: Sequence[str], group: str, per_group: int, per_cell: int, key: str, seed: int | str = 42, usable: Column | None = None) -> DataFrame:
    """At most per_group rows of each group of a cell, then per_cell of the cell, by one keyed order; unusable rows go before the caps."""
    own = rows if usable is None else rows.where(usable)
    return capped(capped(own, [*cell, group], per_group, key, seed), cell, per_cell, key, seed)


def fair_cap(counts: DataFrame, n: str, budget: int) -> DataFrame:
    """cap: the largest number of rows per cell that keeps the sum of min(n, cap) within the budget. counts is a small table, a row per cell."""
    order = W.partitionBy(F.lit(0)).orderBy(n)
    s = counts.select(n, F.sum(n).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.count("*").over(W.partitionBy(F.lit(0))).alias("_all"), F.row_number().over(order).alias("_i"))
    room = F.floor((F.lit(budget) - F.coalesce("_before", F.lit(0))) / (F.col("_all") - F.col("_i") + 1))
    # before each cell in order of size: all smaller ones whole, the rest sharing what is left
    s = s.withColumn("_room", room)
    return s.agg(F.coalesce(F.min_by("_room", F.when(F.col("_room") < F.col(n), F.col("_i"))), F.max(n)).cast("long").alias("cap"))


def map_subset(rows: DataFrame, cell: Sequence[str], whole: Column, budget: int, key: str, seed: int | str = 42) -> DataFrame:
    """All rows where whole holds, and of the others the fair cap of each cell that fits what is left of the budget."""
    kept = rows.where(whole)
    left = rows.where(~whole)
    cap = fair_cap(left.groupBy(*cell).agg(F.count("*").alias("n")), "n", max(0, budget - kept.count()))
    # a cell may have any number of rows: its places are ranked in two levels
    chosen = placed(left, key, seed, cell).withColumn("_cap", cap.scalar()).where("place < _cap").drop("place", "_cap")
    return kept.unionByName(chosen)


def quotas(rows: DataFrame, by: str, total: int) -> DataFrame:
    """by, n, quota: proportional to n with half-even rounding; the last by name takes what is left, nothing below 0 or above n."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    everything = W.partitionBy(F.lit(0))
    share = F.bround(F.col("n") * total / F.sum("n").over(everything), 0).cast("long")
    n = n.withColumn("_q", share).withColumn("_last", F.col(by) == F.max(by).over(everything))
    rest = F.lit(total) - F.coalesce(F.sum(F.when(~F.col("_last"), F.col("_q"))).over(everything), F.lit(0))
    return n.select(by, "n", F.least("n", F.greatest(F.lit(0), F.when(F.col("_last"), rest).otherwise(F.col("_q")))).cast("long").alias("quota"))


def stratified(rows: DataFrame, by: str, total: int, key: str, seed: int | str = 42) -> DataFrame:
    """About total rows, each stratum by its quota in keyed random order; what rounding leaves short is topped up from the rest."""
    dealt = staged(quotas(rows, by, total), "quotas")  # a row per stratum
    sums = dealt.agg(F.sum("n").alias("n"), F.sum("quota").alias("quota")).first()
    ranked = placed(rows, key, seed, [by]).join(dealt.select(by, "quota"), by)
    picked = ranked.where("place < quota")
    short = max(0, min(total, sums["n"] or 0) - (sums["quota"] or 0))
    if short:
        picked = picked.unionByName(first(ranked.where("place >= quota"), short, key, f"{seed}-more"))
    return picked.drop("place", "quota")


def undersampled(rows: DataFrame, by: str, key: str, label: str = "label", seed: int | str = 42) -> DataFrame:
    """The smaller class whole and as many rows of the larger, stratified."""
    n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    small = min(n, key=lambda c: (n[c], c))
    parts = [rows.where(F.col(label) == c) if c == small else stratified(rows.where(F.col(label) == c), by, n[small], key, seed) for c in sorted(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oversampled(rows: DataFrame, key: str, label: str = "label", seed: int | str = 42) -> DataFrame:
    """Each class repeated to the size of the largest: whole copies, then the first rows in keyed order. copy numbers the repeats."""
    sized = rows.groupBy(label).agg(F.count("*").alias("_c"))
    most = sized.agg(F.max("_c"))
    ranked = placed(rows, key, seed, [label]).join(sized, label).withColumn("_m", most.scalar())
    copies = F.floor((F.col("_m") - F.col("place") - 1) / F.col("_c")) + 1
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("place", "_c", "_m")


def allocation(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """name, amount: total dealt by weight, the largest remainders rounded up (ties by name). A small table."""
    everything = W.partitionBy(F.lit(0))
    exact = F.col(weight) * total / F.sum(weight).over(everything)
    w = weights.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.lit(total) - F.sum("_f").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), name))
    return w.withColumn("_left", left).withColumn("_r", rank).select(name, (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("long")).cast("long").alias("amount"))


def weighted(rows: DataFrame, weight: str, n: int, key: str, seed: int | str = 42) -> DataFrame:
    """n rows without replacement, chances by weight, with their Gumbel key."""
    g = rows.withColumn("gumbel", gumbel(F.col(weight), uniform(seed, F.col(key))))
    return g.orderBy(F.desc("gumbel"), key).limit(n)


def before(rows: DataFrame, key: str, order: Sequence[str], part: str, sums: dict[str, Column]) -> DataFrame:
    """rows with a column for each of sums: its sum over the rows of the same key that come before in order.

    rows are parted by ranges of the order (part), so sums run inside (key, part) and are lifted by the earlier parts' totals: a key's rows are
    never one task's. Keys aren't null.
    """
    totals = rows.groupBy(key, part).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each part at most
    lifts = totals.select(key, part, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums])
    inside = W.partitionBy(key, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return own.join(lifts, [key, part]).withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums}).drop(*[f"_t_{n}" for n in sums])


def settled(live: DataFrame, order: Sequence[str], caps: dict[str, int]) -> DataFrame:
    """The taken rows of a walk over live rows (with _part, _in and the keys of caps), once no row is open."""
    while not live.where("NOT _in").isEmpty():
        judged = live
        for c in caps:
            judged = before(judged, c, order, "_part", {f"_taken{c}": F.col("_in").cast("long"), f"_open{c}": (~F.col("_in")).cast("long")})
        out, sure = F.lit(False), F.lit(True)
        for c, cap in caps.items():
            out, sure = out | (F.col(f"_taken{c}") >= cap), sure & (F.col(f"_taken{c}") + F.col(f"_open{c}") < cap)
        kept = judged.where(F.col("_in") | ~out)
        live = staged(kept.withColumn("_in", F.col("_in") | sure).select(*live.columns), "walk")
    return live


def two_caps(rows: DataFrame, order: Sequence[str], group: str, cap_group: int, bucket: str, cap_bucket: int, n: int | None = None) -> DataFrame:
    """Rows that a walk in order takes while neither their group nor their bucket is full; the first n.

    The walk's answer is the only one in which a row is taken if and only if fewer than cap taken rows of its group, and of its bucket, come
    before it. Each round settles rows for certain: a row is in if fewer than cap taken or open rows come before it on both sides, and out if cap
    taken ones do on one. The first open row always settles, so the rounds end. Rows are parted once, by ranges of the order; rounds count
    inside parts and lift by the parts before (see `before`), and only taken and open rows go on. With n, the walk goes over a first run of parts,
    and over as many again while fewer than n are taken. Nulls are a group, and a bucket, of their own; rows equal in all of order are taken
    in any order. Building the result runs the rounds' jobs.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    ranged = rows.withColumn("_g", key(group)).withColumn("_b", key(bucket)).withColumn("_tie", F.monotonically_increasing_id())
    walk = [*order, "_tie"]
    ranged = staged(ranged.repartitionByRange(*walk).sortWithinPartitions(*walk).withColumn("_part", F.spark_partition_id()), "walk")
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    wanted, done, taken = 8 * n if n is not None else None, -1, ranged.limit(0).withColumn("_in", F.lit(True))
    while True:
        parts, seen = [p for p in sorted(sizes) if p > done], 0
        for p in parts:
            seen, last = seen + sizes[p], p
            if wanted is not None and seen >= wanted:
                break
        if not parts:
            break
        fresh = ranged.where((F.col("_part") > done) & (F.col("_part") <= last)).withColumn("_in", F.lit(False))
        taken = settled(taken.unionByName(fresh), walk, {"_g": cap_group, "_b": cap_bucket})
        done, wanted = last, 2 * wanted if wanted is not None else None
        if n is not None and taken.count() >= n:
            break
    out = taken.orderBy(*walk).limit(n) if n is not None else taken
    return out.select(*rows.columns)


def split(rows: DataFrame, share: float, key: str, label: str = "label", seed: int | str = 42) -> DataFrame:
    """rows with is_val: of each label the rounded share in keyed order, at least one row and never all; a label with one row has none."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    take = F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0).cast("long")), F.col("_n") - 1)
    return placed(rows, key, seed, [label]).join(sizes, label).withColumn("is_val", F.col("place") < take).drop("place", "_n")


def folds(rows: DataFrame, group: str, k: int = 5, label: str = "label", seed: int | str = 42) -> DataFrame:
    """rows with fold: a group lies in one fold; groups are dealt round by their majority label in keyed order."""
    g = rows.groupBy(group).agg(F.mode(label, True).alias("_y"))
    dealt = placed(g, group, seed, ["_y"]).select(group, F.pmod("place", F.lit(k)).cast("int").alias("fold"))
    return rows.join(dealt, group)


def dealt(classes: pd.DataFrame, k: int) -> pd.DataFrame:
    """classes (n0, n1: rows of label 0 and 1 in a group; m: groups of that kind) with base and rest: each fold gets base of a class, the folds in rest one more.

    Classes go from large groups to small. What is left of a class goes, one group after the other, where it keeps the folds' shares of both labels
    closest to each other; ties go to the fold with fewer rows, then to the first.
    """
    classes = classes.assign(size=classes["n0"] + classes["n1"]).sort_values(["size", "n1"], ascending=False)
    have, total = np.zeros((k, 2)), np.maximum(1, (classes[["n0", "n1"]].to_numpy() * classes[["m"]].to_numpy()).sum(0))
    rest = []
    for n0, n1, m in classes[["n0", "n1", "m"]].itertuples(index=False):
        own, one = [], np.array([n0, n1])
        have += one * (m // k)
        for _ in range(m % k):
            share = have / total
            # the spread after giving the group to each fold; of a fold that got one of this class, the others come first
            spread = [(own.count(f), round(float(np.var(np.where(np.arange(k)[:, None] == f, share + one / total, share), axis=0).sum()), 15), have[f].sum(), f) for f in range(k)]
            best = min(spread)[3]
            own.append(best)
            have[best] += one
        rest.append(own)
    return classes.assign(base=classes["m"] // k, rest=rest).drop(columns="size")


def balanced_folds(rows: DataFrame, group: str, k: int = 5, label: str = "label", by: Sequence[str] = (), seed: int | str = 42) -> DataFrame:
    """rows with fold, within each value of by (not null): a group lies in one fold, and each fold gets about as many rows of label 0 and of label 1.

    Groups count by their (rows of label 0, rows of label 1): such classes are dealt, not groups, and a class's groups take its places in keyed order. So
    the work beside counting grows with the distinct classes, and of each class the folds differ by one group at most.
    """
    whole = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    groups = rows.groupBy(*whole, group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) != 0).alias("n1"))
    groups = staged(groups.where(F.col(group).isNotNull()), "groups")
    classes = groups.groupBy(*whole, "n0", "n1").agg(F.count("*").alias("m"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    places = classes.groupBy(*whole).applyInPandas(lambda own: dealt(own, k), f"{kinds}, base long, rest array<int>")
    of_class = [*whole, "n0", "n1"]
    fold = F.when(F.col("place") < F.col("base") * k, F.pmod("place", F.lit(k))).otherwise(F.get("rest", (F.col("place") - F.col("base") * k).cast("int")))
    found = placed(groups, group, seed, of_class).join(places.drop("m"), of_class).select(*whole, group, fold.cast("int").alias("fold"))
    return rows.join(found, [*whole, group]).drop("_all")
