"""Operators that rewrite or audit paths and flatten reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import paths, scores


def rewrite_counts(rows: DataFrame, path: str, rules: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """n_rows and n_rewritten by key, the longest rule winning."""
    new = paths.longest_rewritten(F.col(path), rules)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(new != F.col(path)).alias("n_rewritten"))


def prefix_audit(rows: DataFrame, path: str, prefixes: Sequence[str]) -> DataFrame:
    """How many of all rows lie under none of the prefixes."""
    covered = F.lit(False)
    for p in prefixes:
        covered = covered | paths.under(F.col(path), p)
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~covered).alias("n_uncovered"))


def flat_metrics(rows: DataFrame, keys: Sequence[str], report: str, depth: int = 3) -> DataFrame:
    """keys, metric, metric_value: the numbers of a JSON report under dotted names; a list of numbers gives its last. Other values are left out."""
    level = rows.select(*keys, F.lit("").alias("metric"), F.col(report).alias("_json"))
    found = None
    for _ in range(depth):
        entry = F.from_json("_json", "map<string,string>")
        level = level.select(*keys, "metric", F.explode(entry).alias("_k", "_json")).select(*keys, F.when(F.col("metric") == "", F.col("_k")).otherwise(F.concat_ws(".", "metric", "_k")).alias("metric"), "_json")
        values = F.from_json("_json", "array<string>")
        numeric = F.forall(values, lambda x: scores.forgiving(x).isNotNull())
        last = F.when(F.col("_json").startswith("[") & numeric, scores.forgiving(F.try_element_at(values, F.lit(-1))))
        own = level.select(*keys, "metric", F.coalesce(last, scores.forgiving(F.col("_json"))).alias("metric_value")).where("metric_value IS NOT NULL")
        found = own if found is None else found.unionByName(own)
        level = level.where(F.col("_json").startswith("{"))
    return found


def distinct_depth(rows: DataFrame, path: str, keys: Sequence[str], deepest: int = 12) -> DataFrame:
    """keys, depth: the fewest last components of a path that keep all paths of a key apart."""
    p = F.split(path, "/")
    each = rows.select(*keys, F.size(p).alias("_n"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(deepest))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(p, -k, k), "/").alias("suffix")))).alias("_s"))
    counted = each.groupBy(*keys, "_s.depth").agg(F.count("*").alias("n"), F.count_distinct("_s.suffix").alias("u"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return counted.join(total, list(keys)).where("n = u AND n = total").groupBy(*keys).agg(F.min("depth").cast("long").alias("depth"))
