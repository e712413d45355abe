"""Detection metrics over scored rows: error rates, equal error rate, AUC, DET curves; per key or global.

The positive label is a parameter. frr is the share of positives below a threshold, far that of negatives above it, in percent.
Curves come from counts per distinct score and a prefix sum in two levels (buckets of the score, then inside each), so neither
a global curve nor a hot key is sorted in one task. The counts are written to the shared folder once, so each input is read once however
often a curve is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.scores import usable
from tallyforge.sources.staging import staged

#: Distinct scores that a task of a prefix sum sorts, about; the number of buckets follows from it.
PER_BUCKET = 50_000


def counts(rows: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", positive: int = 1) -> DataFrame:
    """keys, score, pos, neg for each distinct usable score."""
    is_pos = F.col(label) == positive
    return rows.where(usable(F.col(score)) & F.col(label).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg"))


def running(table: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], per_bucket: int = PER_BUCKET) -> DataFrame:
    """table with below_<c> and all_<c> for each of sums: the sum over rows of the key with a smaller order value, and over all of the key.

    Order values are distinct within a key. Values are bucketed at approximate quantiles of the whole table; each (key, bucket) is summed
    for itself and lifted by the key's earlier buckets. The number of buckets grows with the table.
    """
    table = staged(table, "counts")
    n = table.count()
    buckets = max(1, -(-n // per_bucket))
    # at most as many bounds as the table has buckets
    bounds = table.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("b")).first()["b"] if buckets > 1 else []
    place = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    table = table.withColumn("_bucket", F.size(F.filter(place, lambda b: b <= F.col(order))))
    own = table.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    of_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = of_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    lifts = own.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_l_{c}") for c in sums], *[F.sum(f"_s_{c}").over(of_key).alias(f"all_{c}") for c in sums])
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    names = table.columns
    table = table.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in sums])
    joined = table.join(lifts, [*keys, "_bucket"])
    return joined.select(*names, *[(F.col(f"_i_{c}") + F.col(f"_l_{c}")).alias(f"below_{c}") for c in sums], *[f"all_{c}" for c in sums]).drop("_bucket")


def rates(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, threshold, frr, far of a running table of pos and neg; keys with one class only are left out."""
    frr = 100.0 * F.col("below_pos") / F.col("all_pos")
    far = 100.0 * (F.col("all_neg") - F.col("below_neg")) / F.col("all_neg")
    return run.where("all_pos > 0 AND all_neg > 0").select(*keys, F.col("score").alias("threshold"), frr.alias("frr"), far.alias("far"))


def with_top(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A curve and, for each key, a threshold a little above its largest."""
    curve = staged(curve, "sweep")
    top = curve.groupBy(*keys).agg((F.max("threshold") + 1e-6).alias("threshold")).where("threshold IS NOT NULL")
    return curve.unionByName(top.select(*keys, "threshold", F.lit(100.0).alias("frr"), F.lit(0.0).alias("far")))


def sweep(rows: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", positive: int = 1, sentinel: bool = True) -> DataFrame:
    """keys, threshold, frr, far (percent) at every distinct score, and with sentinel a little above the largest; keys with one class only are left out."""
    out = rates(running(counts(rows, keys, score, label, positive), keys, "score", ["pos", "neg"]), keys)
    return with_top(out, keys) if sentinel else out


def eer_of(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.min_by(F.struct("threshold", "frr", "far"), F.struct(F.round(F.abs(F.col("frr") - F.col("far")), 9), "threshold"))
    found = curve.groupBy(*keys).agg(best.alias("b")).where("b IS NOT NULL")
    return found.select(*keys, ((F.col("b.frr") + F.col("b.far")) / 2).alias("eer"), F.col("b.threshold").alias("eer_threshold"))


def eer(rows: DataFrame, keys: Sequence[str] = (), sentinel: bool = True, **names) -> DataFrame:
    """keys, eer (percent), eer_threshold: the first threshold where frr and far are closest, and their mean there."""
    return eer_of(sweep(rows, keys, sentinel=sentinel, **names), keys)


def at_rates(own: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    frr, far = F.when(both, 100.0 * F.col("_low") / F.col("n_pos")), F.when(both, 100.0 * F.col("_high") / F.col("n_neg"))
    return own.select(*keys, "n_pos", "n_neg", frr.alias("frr"), far.alias("far"), frr.alias("bpcer"), far.alias("apcer"), ((frr + far) / 2).alias("acer"))


def at_threshold(rows: DataFrame, t: float, keys: Sequence[str] = (), score: str = "score", label: str = "label", positive: int = 1) -> DataFrame:
    """keys, n_pos, n_neg, frr, far, bpcer, apcer, acer at a fixed threshold, strict on both sides; null with an empty class."""
    s, is_pos = F.col(score), F.col(label) == positive
    own = rows.where(usable(s)).groupBy(*keys).agg(F.count_if(is_pos).alias("n_pos"), F.count_if(~is_pos).alias("n_neg"), F.count_if(is_pos & (s < t)).alias("_low"), F.count_if(~is_pos & (s > t)).alias("_high"))
    return at_rates(own, keys)


def metric_row(rows: DataFrame, t: float = 0.5, keys: Sequence[str] = (), score: str = "score", label: str = "label", positive: int = 1) -> DataFrame:
    """at_threshold with eer and eer_threshold: one row per key. Both come from the counts per score, so rows are read once."""
    own = staged(counts(rows, keys, score, label, positive), "counts")
    best = eer_of(with_top(rates(running(own, keys, "score", ["pos", "neg"]), keys), keys), keys)
    sums = own.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.when(F.col("score") < t, F.col("pos")).otherwise(0)).alias("_low"), F.sum(F.when(F.col("score") > t, F.col("neg")).otherwise(0)).alias("_high"))
    fixed = at_rates(sums, keys)
    if keys:
        return fixed.join(best, list(keys), "left")
    return fixed.withColumn("_one", F.lit(1)).join(best.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def auc(rows: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", positive: int = 1) -> DataFrame:
    """keys, auc: the chance that a positive scores above a negative, ties counting half; null with an empty class."""
    run = running(counts(rows, keys, score, label, positive), keys, "score", ["pos", "neg"])
    wins = F.sum(F.col("pos") * F.col("below_neg") + 0.5 * F.col("pos") * F.col("neg"))
    return run.groupBy(*keys).agg(wins.alias("_w"), F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n")).select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / (F.col("_p") * F.col("_n"))).alias("auc"))


def det(rows: DataFrame, keys: Sequence[str] = (), points: int = 64, **names) -> DataFrame:
    """keys, threshold, frr, far: every step-th point of the sweep, step being a points-th of it."""
    curve = sweep(rows, keys, **names).withColumn("_one", F.lit(1))
    placed = running(curve, keys, "threshold", ["_one"])
    step = F.greatest(F.lit(1), F.floor(F.col("all__one") / points))
    return placed.where(F.pmod(F.col("below__one"), step) == 0).select(*keys, "threshold", "frr", "far")


def document_scores(patches: DataFrame, doc: str, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """doc, keys, n_patches, rule, doc_score for the rules mean_score, mean_logit, median, max and top3."""
    from tallyforge.functions.scores import logit

    s, doc_keys = F.col(score), [doc, *keys]
    rank = F.row_number().over(W.partitionBy(*doc_keys).orderBy(s.desc_nulls_last()))
    ranked = patches.select(*doc_keys, s.alias("_s"), rank.alias("_n"))  # the aggregate runs where the ranks are: one shuffle
    best = F.avg(F.when(F.col("_n") <= 3, F.col("_s"))).alias("top3")
    own = ranked.groupBy(*doc_keys).agg(F.count("*").alias("n_patches"), F.avg("_s").alias("mean_score"), F.avg(logit(F.col("_s"))).alias("mean_logit"), F.percentile("_s", 0.5).alias("median"), F.max("_s").alias("max"), best)
    return own.unpivot([*doc_keys, "n_patches"], ["mean_score", "mean_logit", "median", "max", "top3"], "rule", "doc_score")


def row_errors(rows: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """rows with error: label 1 below its key's eer_threshold is missed, label 0 at or above it rejected. thresholds has a row per key."""
    j = rows.join(thresholds.select(*keys, "eer_threshold"), list(keys), "left")
    s, t = F.col(score), F.col("eer_threshold")
    return j.withColumn("error", F.when((F.col(label) == 1) & (s < t), "missed").when((F.col(label) == 0) & (s >= t), "rejected"))


def change_from(metrics: DataFrame, keys: Sequence[str], factor: str, baseline: str, value: str) -> DataFrame:
    """metrics with change: value less that of the baseline factor with the same keys."""
    base = metrics.where(F.col(factor) == baseline).select(*keys, F.col(value).alias("_base"))
    return metrics.join(base, list(keys), "left").withColumn("change", F.col(value) - F.col("_base")).drop("_base")
