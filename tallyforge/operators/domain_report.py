"""The parts of a domain report: errors at the production threshold, cells with all their measures, breakdowns, overlaps and findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators import metrics

#: Coverage under which a production row counts as uncovered.
UNCOVERED = 0.25


def production_errors(rows: DataFrame, prod: Column, score: str = "score", label: str = "label") -> DataFrame:
    """rows with error: whether the score is wrong at the production rows' equal-error threshold (label 1 below it, label 0 at or above it).

    Null without a usable score, and for all rows if production has scores of one label only. Building the result runs jobs (a sweep).
    """
    usable = F.col(score).isNotNull() & ~F.isnan(score)
    at = metrics.eer(rows.where(prod & usable), sentinel=False, score=score, label=label).select(F.max("eer_threshold"))  # one row, or none
    wrong = F.when(F.col(label) == 1, F.col(score) < F.col("_t")).otherwise(F.col(score) >= F.col("_t"))
    return rows.withColumn("_t", at.scalar()).withColumn("error", F.when(usable & F.col("_t").isNotNull(), wrong)).drop("_t")


def nearest_cells(affinity: DataFrame, k: int = 3) -> DataFrame:
    """cell, self_lift, nearest: a cell's affinity to itself and the k other cells of the largest (ties by name). affinity: src, dst, log_lift."""
    others = affinity.where("src <> dst").withColumn("n", F.row_number().over(W.partitionBy("src").orderBy(F.desc("log_lift"), "dst"))).where(F.col("n") <= k)
    named = others.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "dst"))), lambda x: x["dst"]).alias("nearest"))  # k names
    own = affinity.where("src = dst").select(F.col("src").alias("cell"), F.col("log_lift").alias("self_lift"))
    return own.join(named.withColumnRenamed("src", "cell"), "cell", "left").withColumn("nearest", F.coalesce("nearest", F.expr("array()").cast("array<string>")))


def cell_table(rows: DataFrame, cell: Sequence[str], role: str, group: str, measures: Sequence[DataFrame]) -> DataFrame:
    """A row for each cell: role, n, n_groups, error (share of its scored rows), then the measures' columns, joined by the cell. rows have error."""
    own = rows.groupBy(*cell).agg(F.min(role).alias("role"), F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), F.avg(F.col("error").cast("double")).alias("error"))
    return reduce(lambda left, right: left.join(right, list(cell), "left"), measures, own)


def breakdown(rows: DataFrame, columns: Sequence[str], label: str, key: str, nearest: str, uncovered: float = UNCOVERED, support: int = 5, top: int = 2) -> DataFrame:
    """meta, value, label, n, coverage (mean, each at most 1), uncovered, error and the `top` most frequent nearest values, of production rows.

    rows have coverage, error and the nearest column. Values under the support, null and empty ones are left out.
    """
    long = rows.select(key, label, "coverage", "error", F.col(nearest).alias("_near"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key, label, "coverage", "error", "_near"], list(columns), "meta", "value")
    long = long.where("value <> ''")
    of = ["meta", "value", label]
    whole = long.groupBy(*of).agg(F.count("*").alias("n"), F.avg(F.least(F.col("coverage"), F.lit(1.0))).alias("coverage"), F.count_if(F.col("coverage") < uncovered).alias("uncovered"), F.avg(F.col("error").cast("double")).alias("error"))
    near = long.where("_near IS NOT NULL").groupBy(*of, "_near").agg(F.count("*").alias("_n"))
    near = near.withColumn("_r", F.row_number().over(W.partitionBy(*of).orderBy(F.desc("_n"), "_near"))).where(F.col("_r") <= top)
    near = near.groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_near"))), lambda x: x["_near"]).alias("nearest"))
    return whole.where(F.col("n") >= support).join(near, of, "left")


def overlaps(rows: DataFrame, path: str, source: str, order: str) -> DataFrame:
    """kept_in, dropped_from, n: paths that a later source has as well; the first source by order keeps each."""
    has = rows.where(F.col(path).isNotNull()).groupBy(path, source).agg(F.min(order).alias("_o"))
    first = has.groupBy(path).agg(F.min(F.struct("_o", source)).alias("_f"))
    return has.join(first, path).where(F.col(source) != F.col(f"_f.{source}")).groupBy(F.col(f"_f.{source}").alias("kept_in"), F.col(source).alias("dropped_from")).agg(F.count("*").alias("n"))


def findings(production: DataFrame, cells: DataFrame, groups: DataFrame, shared: DataFrame, uncovered: float = UNCOVERED, separable: float = 0.99) -> DataFrame:
    """kind, label, subject, amount: what a report says in words, a rule a select.

    production: label, coverage, error of production rows. cells: domain, label, role, n, lift, auc, delta_covered. groups: a breakdown. shared: overlaps.
    """
    low = F.col("coverage") < uncovered
    errors = production.groupBy("label").agg(*[f.alias(f"{name}_{side}") for side, of in (("low", low), ("ok", ~low)) for name, f in (("n", F.count_if(of)), ("err", F.avg(F.when(of, F.col("error").cast("double")))))])
    gap = F.col("err_low") - F.col("err_ok")
    train = cells.where("role = 'train'")
    train = train.join(train.groupBy("label").agg(F.percentile("n", 0.5).alias("middle")), "label")  # a row for each cell
    outside = cells.where("role <> 'prod'")
    row = lambda kind, subject, amount, label="label": [F.lit(kind).alias("kind"), F.expr(label).cast("int").alias("label"), subject.cast("string").alias("subject"), amount.cast("double").alias("amount")]
    rules = [
        production.groupBy("label").agg(F.avg(low.cast("double")).alias("a")).select(*row("coverage", F.lit(None), F.col("a"))),
        errors.where("least(n_low, n_ok) >= 10 AND err_low IS NOT NULL AND err_ok IS NOT NULL").select(*row("model", F.when(gap > 0.05, "tracks").otherwise("does not"), gap)),
        groups.where("uncovered >= greatest(5, 0.5 * n)").orderBy(F.desc("uncovered"), F.desc("n"), "meta", "value", "label").limit(5).select(*row("uncovered_group", F.concat_ws("=", "meta", "value"), F.col("uncovered"))),
        outside.where("role IN ('candidate', 'test') AND delta_covered > 0").select(*row("candidate", F.col("domain"), F.col("delta_covered"))),
        train.where("lift >= 2 AND n < middle").select(*row("collect", F.col("domain"), F.col("lift"))),
        train.where("lift < 0.3 AND coalesce(delta_covered, 0) = 0").select(*row("low", F.col("domain"), F.col("lift"))),
        outside.where(F.col("auc") >= separable).select(*row("separable", F.col("domain"), F.col("auc"))),
        shared.select(*row("leak", F.concat_ws(" in ", "dropped_from", "kept_in"), F.col("n"), "NULL")),
    ]
    return reduce(DataFrame.unionByName, rules)
