"""Readers of manifests, predictions, reports and registries; all return DataFrames with plain types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import boxes, paths, scores
from tallyforge.operators import audit, sampling
from tallyforge.operators.rewriting import flat_metrics

ROLES = ("prod", "train", "test", "candidate")
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def read_csv(spark: SparkSession, path: str | Sequence[str], required: Sequence[str] = (), **options) -> DataFrame:
    """All columns as trimmed text under their own names; quotes are doubled inside quoted fields, a BOM is dropped, bad bytes are replaced."""
    df = spark.read.options(header=True, escape='"', mode="PERMISSIVE", encoding="UTF-8", **options).csv(path if isinstance(path, str) else list(path))
    audit.require(df, *required)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])


def manifest(spark: SparkSession, path: str | Sequence[str], folder: str = "", require_bbox: bool = False, limit: int | None = None) -> DataFrame:
    """path, label, bbox, dataset (where they are there) and all other columns; paths are resolved against the folder, blank ones dropped."""
    df = read_csv(spark, path, ["path", "label", *["bbox"] * require_bbox])
    df = audit.with_path(df, "path").withColumn("path", paths.resolved(F.col("path"), F.lit(folder))).withColumn("label", audit.lenient_label(F.col("label")))
    if "bbox" in df.columns:
        df = df.withColumn("bbox", boxes.box(F.col("bbox")))
    if "dataset" in df.columns:
        df = df.withColumn("dataset", paths.defaulted(F.col("dataset"), "unknown"))
    return df if limit is None else df.orderBy("path").limit(limit)


def several(parts: Sequence[DataFrame], order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Tables one after the other, columns by name; with a limit the first rows in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out if limit is None else out.orderBy(*order).limit(limit)


def domain_manifest(rows: DataFrame, order: Sequence[str], rules: Sequence[tuple[str, str]] = (), split_col: str | None = None, source: str = "source", group_by: str = "auto", meta: Sequence[str] = ()) -> DataFrame:
    """orig, path, label, domain, grp, score, meta: the first row of each original path, remapped, with domain from split_col or the source's name."""
    once = sampling.keep_first(rows.where(F.trim("path") != ""), ["path"], order)
    path = paths.rewritten(F.col("path"), rules)
    domain = paths.defaulted(F.col(split_col).cast("string"), "(empty)") if split_col else F.lit(source)
    score = F.col("score").try_cast("double") if "score" in rows.columns else F.lit(None).cast("double")
    extra = F.create_map(*[x for c in meta for x in (F.lit(c), F.col(c).cast("string"))]) if meta else F.expr("cast(map() as map<string,string>)")
    return once.select(F.col("path").alias("orig"), path.alias("path"), F.col("label").cast("int").alias("label"), domain.alias("domain"), paths.session(path, group_by).alias("grp"), score.alias("score"), extra.alias("meta"))


def image_files(spark: SparkSession, folder: str, recursive: bool = True, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """path, length of the files with one of the suffixes, in any case; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    return df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels, data; an unreadable file has is_bad."""
    df = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
    return df.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), (F.col("image.height") <= 0).alias("is_bad"))


def readable(rows: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """rows with status: ok, unreadable or missing. found: path, is_bad; a path that is there twice is bad if one of them is."""
    once = found.groupBy(F.col("path").alias(path)).agg(F.max("is_bad").alias("is_bad"))
    return rows.join(once, path, "left").withColumn("status", F.when(F.col("is_bad").isNull(), "missing").when(F.col("is_bad"), "unreadable").otherwise("ok")).drop("is_bad")


def predictions(rows: DataFrame) -> DataFrame:
    """path, label, score, logit; the logit, where it is missing, from the score."""
    given = F.col("logit").try_cast("double") if "logit" in rows.columns else F.lit(None).cast("double")
    s = F.col("score").try_cast("double")
    return rows.select("path", F.col("label").cast("int").alias("label"), s.alias("score"), F.coalesce(given, scores.logit(s)).alias("logit"))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row, by order, of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def reports(spark: SparkSession, pattern: str) -> DataFrame:
    """run, metric, metric_value of JSON reports, one document in a file; the run is the file's folder."""
    text = spark.read.text(pattern, wholetext=True).select(paths.name_of(paths.parent(F.col("_metadata.file_path"))).alias("run"), "value")
    return flat_metrics(text, ["run"], "value")


def history(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, metric, metric_value of a wide table of numbers or text; blank cells and text are dropped."""
    names = [c for c in rows.columns if c not in keys]
    long = rows.select(*keys, *[F.col(c).cast("string").alias(c) for c in names]).unpivot(list(keys), names, "metric", "cell")
    return long.select(*keys, "metric", scores.forgiving(F.col("cell")).alias("metric_value")).where("metric_value IS NOT NULL")


def history_from_lists(rows: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """key, epoch (from 1) and a column for each list."""
    e = rows.select(key, F.posexplode(F.arrays_zip(*lists)).alias("_p", "_z"))
    return e.select(key, (F.col("_p") + 1).alias("epoch"), *[F.col(f"_z.{c}").alias(c) for c in lists])


def registry(text: DataFrame, column: str = "value") -> DataFrame:
    """name, csv, role, split_col, group_by of a JSON registry's sources, with defaults; roles and names are checked by registry_errors."""
    schema = "sources array<struct<name:string,csv:string,role:string,split_col:string,group_by:string>>"
    s = text.select(F.explode(F.from_json(column, schema)["sources"]).alias("s")).select("s.*")
    return s.select("name", "csv", F.coalesce("role", F.lit("train")).alias("role"), "split_col", F.coalesce("group_by", F.lit("auto")).alias("group_by"))


def registry_errors(sources: DataFrame) -> DataFrame:
    """name, problem: roles that don't exist, names that occur twice."""
    bad = sources.where(~F.col("role").isin(*ROLES)).select("name", F.lit("role").alias("problem"))
    twice = sources.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("name").alias("problem"))
    return bad.unionByName(twice)


def uri_parts(uri: Column) -> Column:
    """scheme, bucket, key."""
    part = lambda i: F.regexp_extract(uri, r"^([a-z0-9]+)://([^/]+)/?(.*)$", i)
    return F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key"))


def remote_paths(rows: DataFrame, path: str, scheme: str = "s3") -> DataFrame:
    return rows.where(F.col(path).startswith(f"{scheme}://")).select(path).distinct()


def media_links(rows: DataFrame) -> DataFrame:
    """media_id, source_media_id as trimmed text, blank for missing."""
    return rows.select(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in ("media_id", "source_media_id")])
