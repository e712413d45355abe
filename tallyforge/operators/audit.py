"""Audits and filters of manifests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import boxes
from tallyforge.sources.staging import staged


class MissingColumns(ValueError):
    """Required columns are absent; names lists them."""

    def __init__(self, names: Sequence[str]):
        super().__init__(f"missing columns: {', '.join(names)}")
        self.names = list(names)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all the columns; no job runs."""
    if absent := [c for c in columns if c not in df.columns]:
        raise MissingColumns(absent)
    return df


def strict_label(text: Column) -> Column:
    """0 or 1 where the text is exactly that, else null."""
    return F.when(F.trim(text).isin("0", "1"), F.trim(text).cast("int"))


def lenient_label(text: Column) -> Column:
    """As strict_label, for any number equal to 0 or 1."""
    x = text.try_cast("double")
    return F.when(x.isin(0.0, 1.0), x.cast("int"))


def with_path(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.trim(path) != "")


def decided(rows: DataFrame, column: str, decision: str) -> DataFrame:
    return rows.where(F.upper(F.trim(column)) == decision.upper())


def missing_counts(rows: DataFrame, listing: DataFrame, path: str, file: str, keys: Sequence[str]) -> DataFrame:
    """n_rows, n_found, n_missing by key against a listing of files."""
    seen = listing.select(F.col(file).alias("_file")).distinct()
    return rows.join(seen, F.col(path) == F.col("_file"), "left").groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("_file").alias("n_found"), F.count_if(F.col("_file").isNull()).alias("n_missing"))


def existing(rows: DataFrame, listing: DataFrame, path: str, file: str, on_missing: str = "skip", preview: int = 20) -> DataFrame:
    """Rows whose file is listed; with on_missing="raise" an error names the first ones that aren't."""
    seen = listing.select(F.col(file).alias("_file"))
    if on_missing == "raise":
        lost = [r[0] for r in rows.join(seen, F.col(path) == F.col("_file"), "left_anti").select(path).orderBy(path).limit(preview).collect()]
        if lost:
            raise FileNotFoundError(", ".join(map(str, lost)))
    return rows.join(seen, F.col(path) == F.col("_file"), "left_semi")


def box_audit(rows: DataFrame, bbox: str) -> DataFrame:
    """error_class, n."""
    return rows.groupBy(boxes.error_class(F.col(bbox)).alias("error_class")).agg(F.count("*").alias("n"))


def scan_until(files: Sequence[str], load: Callable[[list[str]], DataFrame], status: Column, most: int, good: Sequence[str] = ("ok", "empty"), first: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """The first `most` bad rows of files with their status, in order of file and row, and how many rows of each good status, rows and files were read.

    load reads some files (all columns of theirs have one schema). Files are read in steps of first, 2 first, 4 first, ... until `most` rows are bad; later files
    stay unread. A step is one pass: its counts are observed while its bad rows are written. With fewer bad rows all files are read. Rows
    come with file, row (their order within it) and status. No files, no rows: files must not be empty.
    """
    from pyspark.sql import Observation

    totals: dict[str, int] = {}
    found, at, step = None, 0, max(1, first)
    while at < len(files):
        rows = load(list(files[at : at + step])).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("row", F.monotonically_increasing_id()).withColumn("status", status)
        seen = Observation()
        rows = rows.observe(seen, F.count("*").alias("n"), *[F.count_if(F.col("status") == g).alias(f"n_{i}") for i, g in enumerate(good)])
        place = F.row_number().over(W.partitionBy("file").orderBy("_block", "row"))
        bad = rows.where(~F.col("status").isin(list(good)) | F.col("status").isNull())
        # of a file no more than `most` bad rows can be asked for
        bad = staged(bad.withColumn("_n", place).where(F.col("_n") <= most).drop("_n"), "bad-rows")
        counts = seen.get
        for i, g in enumerate(good):
            totals[g] = totals.get(g, 0) + counts[f"n_{i}"]
        totals["rows"] = totals.get("rows", 0) + counts["n"]
        found = bad if found is None else found.unionByName(bad)
        at, step = at + step, 2 * step
        if found.count() >= most:
            break
    totals["files"] = min(at, len(files))
    order = ["file", "_block", "row"]
    return found.orderBy(*order).limit(most).drop("_block"), totals


def conversion_counts(rows: DataFrame, accepted: Column, converted: Column) -> DataFrame:
    """reason, n: ok, decision (not accepted) or geometry (no box)."""
    reason = F.when(~accepted, "decision").when(converted.isNotNull(), "ok").otherwise("geometry")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def class_exclusion(rows: DataFrame, label: int, excluded: DataFrame, path: str) -> DataFrame:
    """Rows of a class, and those of them in an exclusion table."""
    seen = excluded.select(F.col(path).alias("_x")).distinct()
    own = rows.where(F.col("label") == label)
    return own.join(seen, F.col(path) == F.col("_x"), "left").agg(F.count("*").alias("n_class"), F.count("_x").alias("n_excluded"))


def ranked(rows: DataFrame, keys: Sequence[str], order: str, tie: str, per_bucket: int = 100_000) -> DataFrame:
    """rows with place (0, 1, ... by order, then tie, within each key) and size (the key's rows).

    Rows are bucketed at approximate quantiles of order, as many buckets as they need; each (key, bucket) is ranked for itself and lifted by the
    key's earlier buckets, so no task ranks a whole key. Null order values come first.
    """
    n = rows.count()
    buckets = max(1, -(-n // per_bucket))
    bounds = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("b")).first()["b"] if buckets > 1 else None
    place = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    rows = rows.withColumn("_bucket", F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(place, lambda b: b <= F.col(order)))))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = own.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    lifts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"), F.sum("_n").over(own).alias("size"))
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(order, tie)) - 1
    joined = rows.withColumn("_i", inside).join(lifts, [*keys, "_bucket"])
    return joined.withColumn("place", (F.col("_i") + F.col("_lift")).cast("long")).drop("_bucket", "_i", "_lift")


def percentile_rank(rows: DataFrame, keys: Sequence[str], order: str, tie: str, out: str = "pct") -> DataFrame:
    """rows with out: position / (n - 1) in a key's order; tie must break ties."""
    r = ranked(rows, keys, order, tie)
    return r.withColumn(out, F.col("place") / F.greatest(F.col("size") - 1, F.lit(1)).cast("double")).drop("place", "size")


def is_artefact(name: Column) -> Column:
    """Reports and histories by file name; nothing that climbs out of its folder."""
    return name.rlike(r"(^|/)(report\.json|eval[^/]*\.json|history\.csv|[^/]*config[^/]*\.json)$") & ~name.rlike(r"(^|/)\.\.(/|$)") & ~name.startswith("/")


def all_boxed(rows: DataFrame, bbox: str, keys: Sequence[str]) -> DataFrame:
    """Whether all rows of a key have a good box."""
    n = F.count_if(boxes.box(F.col(bbox)).isNull())
    return rows.groupBy(*keys).agg(n.alias("n_without"), (n == 0).alias("all_boxed"))
