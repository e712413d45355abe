"""Counts, balance, quantiles and effect sizes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators import metrics
from tallyforge.operators.audit import ranked


def label_pivot(rows: DataFrame, key: str, label: str = "label", values: Sequence[int] = (0, 1)) -> DataFrame:
    """key, n_<value> for each label value, 0 where there is none."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(label) == v).alias(f"n_{v}") for v in values])


def label_balance(rows: DataFrame, keys: Sequence[str] = (), label: str = "label", warn: float = 0.05) -> DataFrame:
    """Counts of both labels, whether only one occurs, whether the smaller has less than warn."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    out = rows.groupBy(*keys).agg(n0.alias("n_0"), n1.alias("n_1"))
    low = F.least("n_0", "n_1")
    return out.withColumn("one_class", low == 0).withColumn("rare_class", (low > 0) & (low < warn * (F.col("n_0") + F.col("n_1"))))


def class_weights(rows: DataFrame, label: str = "label", values: Sequence[int] = (0, 1)) -> DataFrame:
    """label, weight: n / (2 n_c), and 1 for a label without rows."""
    n = rows.agg(*[F.count_if(F.col(label) == v).cast("double").alias(f"n{v}") for v in values])
    total = sum((F.col(f"n{v}") for v in values[1:]), F.col(f"n{values[0]}"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(v).alias("label"), F.when(F.col(f"n{v}") > 0, total / (len(values) * F.col(f"n{v}"))).otherwise(1.0).alias("weight")) for v in values])).alias("w")).select("w.*")


def nested_counts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """first, second, n with subtotals and the total, where second or both are null."""
    return rows.rollup(first, second).agg(F.count("*").alias("n"))


def skip_rates(rows: DataFrame, label: str, reason: str) -> DataFrame:
    """label, reason, n, rate: rows of each skip reason (null: kept) and their share of the label's rows."""
    total = W.partitionBy(label)
    own = rows.groupBy(label, reason).agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / F.sum("n").over(total))
    return own.where(F.col(reason).isNotNull())


def balance_findings(rows: DataFrame, label: str, reason: str, gap: float = 0.2, low: float = 0.2) -> DataFrame:
    """finding, reason, amount: one_class output (fatal), skip rates that differ by more than gap between labels, a share of label 1 outside [low, 1 - low]."""
    kept = rows.where(F.col(reason).isNull()).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n1"))
    share = F.col("n1") / F.col("n")
    one = kept.where("n1 = 0 OR n1 = n").select(F.lit("one_class").alias("finding"), F.lit(None).cast("string").alias("reason"), share.alias("amount"))
    skewed = kept.where((F.col("n1") > 0) & (F.col("n1") < F.col("n")) & ((share < low) | (share > 1 - low))).select(F.lit("skewed").alias("finding"), F.lit(None).cast("string").alias("reason"), share.alias("amount"))
    totals = rows.agg(F.count_if(F.col(label) == 0).alias("t0"), F.count_if(F.col(label) == 1).alias("t1"))
    per = rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count_if(F.col(label) == 0).alias("s0"), F.count_if(F.col(label) == 1).alias("s1"))
    rates = per.withColumn("_t0", totals.select("t0").scalar()).withColumn("_t1", totals.select("t1").scalar())
    gaps = rates.select(F.lit("skip_gap").alias("finding"), F.col(reason).alias("reason"), F.abs(F.col("s1") / F.col("_t1") - F.col("s0") / F.col("_t0")).alias("amount")).where(F.col("amount") > gap)
    return one.unionByName(skewed).unionByName(gaps)


def cell_statistics(rows: DataFrame, keys: Sequence[str], group: str, missing: Column, no_box: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.count_if(missing).alias("n_missing"), F.count_if(no_box).alias("n_no_box"))


def selected(rows: DataFrame, value: str, points: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, q (the values at the points, exact, between neighbours by interpolation; nulls and NaN don't count) and n (values that count).

    Values are counted first, and a value's place follows from the counts of the smaller ones, by buckets (`metrics.running`): no task has all the values of
    a key. Keys may be null. Building the result runs jobs.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    packed = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    own = rows.where(usable).select(packed.alias("_key"), *keys, F.col(value).cast("double").alias("_v"))
    names = own.groupBy("_key").agg(*[F.first(c).alias(c) for c in keys], F.lit(1).alias("_one"))
    run = metrics.running(own.groupBy("_key", "_v").agg(F.count("*").alias("_n")), ["_key"], "_v", ["_n"])
    at = lambda place: F.max(F.when((F.col("below__n") <= place) & (place < F.col("below__n") + F.col("_n")), F.col("_v")))
    found = []
    for p in points:
        exact = F.lit(float(p)) * (F.col("all__n") - 1)
        low, high = F.floor(exact), F.ceil(exact)
        found += [at(low).alias(f"_l{len(found)}"), at(high).alias(f"_h{len(found)}"), F.max(exact - low).alias(f"_s{len(found)}")]
    sums = run.groupBy("_key").agg(F.max("all__n").alias("n"), *found)
    q = [F.col(f"_l{3 * i}") + (F.col(f"_h{3 * i}") - F.col(f"_l{3 * i}")) * F.col(f"_s{3 * i}") for i in range(len(points))]
    return sums.select("_key", "n", F.array(*q).alias("q")).join(names, "_key").select(*keys, "q", "n")


def quantiles(rows: DataFrame, value: str, points: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, p<percent> for each point: exact, between neighbours by interpolation."""
    q = selected(rows, value, points, keys)
    return q.select(*keys, *[F.get("q", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


def legibility(rows: DataFrame, keys: Sequence[str], px: str, threshold: float) -> DataFrame:
    """keys, n, p50, p90, share_under: how large what should be unreadable is."""
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(px) < threshold).cast("double")).alias("share_under"))
    return with_quantiles(own, rows, px, {"p50": 0.5, "p90": 0.9}, keys).select(*keys, "n", "p50", "p90", "share_under")


def with_quantiles(table: DataFrame, rows: DataFrame, value: str, points: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """table (a row for each of keys) with a column for each of points."""
    q = selected(rows, value, list(points.values()), keys).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(points)])
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return table.join(q, reduce(Column.__and__, same, F.lit(True)), "left").drop(*[f"_k{i}" for i in range(len(keys))])


def legibility_table(rows: DataFrame, sets: Sequence[str], sizes: Sequence[int], text_px: float = 5, face_px: float = 40) -> DataFrame:
    """dimension, value, size, n, text_under, face_under, median_share: each grouping column by candidate export size, over rows (short, long, frame)."""
    sets_ = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in sets]))
    of = rows.select("short", "long", (F.col("long") / F.col("frame")).alias("_share"), sets_.alias("_d")).select("*", "_d.dimension", "_d.value").drop("_d")
    scale = F.least(F.lit(1.0), F.col("size") / F.col("long"))
    each = of.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    under = lambda part, px: F.avg((part * F.col("short") * scale < px).cast("double"))
    own = each.groupBy("dimension", "value", "size").agg(F.count("*").alias("n"), under(0.04, text_px).alias("text_under"), under(0.35, face_px).alias("face_under"))
    # the share doesn't depend on the size
    return with_quantiles(own, of, "_share", {"median_share": 0.5}, ["dimension", "value"])


def filled_share(rows: DataFrame, sets: Sequence[str], width: Column, height: Column, slack: float = 0.02) -> DataFrame:
    """dimension, value, n, filled: for each value of each grouping column, the share of boxes (x1, y1, x2, y2) at least as wide and high as the frame, less the slack."""
    fills = (F.col("x2") - F.col("x1") >= width * (1 - slack)) & (F.col("y2") - F.col("y1") >= height * (1 - slack))
    of = rows.select(fills.cast("double").alias("_f"), F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in sets])).alias("_d"))
    return of.groupBy("_d.dimension", "_d.value").agg(F.count("*").alias("n"), F.avg("_f").alias("filled"))


def cohens_d(rows: DataFrame, features: str, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """keys, position, d: (mean of label 1 - mean of label 0) / pooled deviation, floor 1e-9, of each feature."""
    each = rows.select(*keys, F.col(label).alias("_y"), F.posexplode(features).alias("position", "_x"))
    x1, x0 = F.when(F.col("_y") == 1, F.col("_x").cast("double")), F.when(F.col("_y") == 0, F.col("_x").cast("double"))
    s = each.groupBy(*keys, "position").agg(F.avg(x1).alias("m1"), F.avg(x0).alias("m0"), F.var_samp(x1).alias("v1"), F.var_samp(x0).alias("v0"))
    return s.select(*keys, "position", ((F.col("m1") - F.col("m0")) / F.greatest(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(1e-9))).alias("d"))


def shortcuts(before: DataFrame, after: DataFrame, on: Sequence[str], large: float = 0.5, kept: float = 0.25) -> DataFrame:
    """on, d_before, d_after, lost, shortcut: a large effect of which less than kept is left, or whose sign turned."""
    j = before.select(*on, F.col("d").alias("d_before")).join(after.select(*on, F.col("d").alias("d_after")), list(on))
    lost = F.abs("d_before") - F.abs("d_after")
    gone = (F.abs("d_after") < kept * F.abs("d_before")) | (F.signum("d_after") * F.signum("d_before") < 0)
    return j.withColumn("lost", lost).withColumn("shortcut", (F.abs("d_before") >= large) & gone)


def selection_summary(rows: DataFrame, arm: str, group: str, bucket: str, score: str) -> DataFrame:
    """arm, n_rows, n_groups, largest_bucket_share, mean_score."""
    a = rows.groupBy(arm).agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.avg(score).alias("mean_score"))
    b = rows.groupBy(arm, bucket).agg(F.count("*").alias("_n")).groupBy(arm).agg((F.max("_n") / F.sum("_n")).alias("largest_bucket_share"))
    return a.join(b, arm)


def most_common(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """keys, value, n, rank: the k most frequent values, ties by value."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def best_epoch(rows: DataFrame, run: str, epoch: str, metric: str, mode: str = "min") -> DataFrame:
    """run, best_epoch, best_value: NaN ignored; of ties the earliest for min and the latest for max."""
    good = rows.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    pick = F.min_by if mode == "min" else F.max_by
    return good.groupBy(run).agg(pick(F.col(epoch), F.struct(metric, epoch)).alias("best_epoch"), (F.min if mode == "min" else F.max)(metric).alias("best_value"))


def run_rollup(rows: DataFrame, run: str, epoch: str, metric: str, tests: DataFrame, test_metric: str) -> DataFrame:
    """run, last_value, test_value (or, without a test, the least over the epochs)."""
    own = rows.groupBy(run).agg(F.max_by(metric, epoch).alias("last_value"), F.min(metric).alias("_least"))
    return own.join(tests.select(run, F.col(test_metric).alias("_t")), run, "left").select(run, "last_value", F.coalesce("_t", "_least").alias("test_value"))


def trial_ranking(rows: DataFrame, run: str, start: str, end: str, metric: str) -> DataFrame:
    """run, minutes, metric, rank: by metric, trials without one last, then by name. Ranked in two levels, so no task has all trials."""
    m = rows.withColumn("minutes", F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 60.0).withColumn("_last", F.coalesce(F.col(metric).cast("double"), F.lit(float("inf"))))
    return ranked(m, [], "_last", run).select(run, "minutes", metric, (F.col("place") + 1).cast("int").alias("rank"))


def dataset_use(rows: DataFrame, dataset: str, steps: int, slots: int) -> DataFrame:
    """dataset, n_rows, reuse (times each row is drawn in steps with one slot a batch), live_slots left in a batch."""
    n = rows.groupBy(dataset).agg(F.count("*").alias("n_rows"))
    return n.select(dataset, "n_rows", (F.lit(float(steps)) / F.col("n_rows")).alias("reuse"), (F.lit(slots) - F.count("*").over(W.partitionBy(F.lit(0)))).alias("live_slots"))


def throughput(rows: DataFrame, run: str, n: str, seconds: str) -> DataFrame:
    """run, mean_rate, steady_rate: rows by mean and by least seconds."""
    return rows.groupBy(run).agg((F.max(n) / F.avg(seconds)).alias("mean_rate"), (F.max(n) / F.min(seconds)).alias("steady_rate"))


def status_totals(rows: DataFrame, status: Column) -> DataFrame:
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
