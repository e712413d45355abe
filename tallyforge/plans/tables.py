"""The library's tables over the given ones: a DataFrame for each, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = """manifest AS (SELECT event_id, user_id, ts, event_type, value, props, '/lake/src' || CAST(user_id % 7 AS VARCHAR) || '/s' || CAST(user_id AS VARCHAR) || '/frames/' || CAST(event_id AS VARCHAR) || '.jpg' AS path,
  CAST(event_type = 'error' AS INT) AS label, 'src' || CAST(user_id % 7 AS VARCHAR) AS dataset, '/lake/src' || CAST(user_id % 7 AS VARCHAR) || '/s' || CAST(user_id AS VARCHAR) AS grp, value / 500.0 AS score FROM events)"""
PATCHES = """patches AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS patch_id, '/lake/docs/' || CAST(l_orderkey AS VARCHAR) || '.jpg' AS source_path,
  CASE l_returnflag WHEN 'N' THEN 'interior' WHEN 'R' THEN 'edge' ELSE 'exterior' END AS zone, CAST(o_orderstatus = 'F' AS INT) AS label,
  round(least(0.999, greatest(0.001, l_quantity / 50.0 * 0.6 + 0.2 * CAST(o_orderstatus = 'F' AS INT) + l_discount)), 3) AS score, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BOXES = """boxes AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS flag, l_linestatus AS status, CAST(l_returnflag = 'R' AS INT) AS label, CASE l_orderkey % 50 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '[1,2]' WHEN 3 THEN '[5,5,5,9]'
  ELSE '[' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR) || ',' || CAST(CAST(l_quantity AS INT) + l_partkey % 900 AS VARCHAR) || ',' || CAST(l_linenumber + l_suppkey % 600 AS VARCHAR) || ']' END AS bbox,
  l_quantity AS x1, CAST(l_linenumber AS DOUBLE) AS y1, l_quantity + l_partkey % 900 AS x2, CAST(l_linenumber + l_suppkey % 600 AS DOUBLE) AS y2, l_orderkey % 50 AS kind FROM lineitem)"""
RUNS = """runs AS (SELECT * FROM (SELECT 'job-' || CAST(o_custkey % 10 AS VARCHAR) || '-' || CAST(o_custkey AS VARCHAR) AS run, o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch,
  o_totalprice / 10000 AS val_eer, count(*) OVER (PARTITION BY o_custkey) AS n_epochs FROM orders) WHERE n_epochs >= 3)"""
LINKS = """links AS (SELECT o_orderkey AS media_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey - 1 END AS source_media_id, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders)"""
SAMPLES = """samples AS (SELECT vec_id, embedding, 'd' || CAST(label AS VARCHAR) AS domain, CASE WHEN label <= 1 THEN 'prod' WHEN label <= 6 THEN 'train' WHEN label = 7 THEN 'test' ELSE 'candidate' END AS role, CAST(vec_id % 2 AS INT) AS label, 'g' || CAST(vec_id // 3 AS VARCHAR) AS grp FROM embeddings)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    src = F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string"))
    grp = F.concat(F.lit("/lake/"), src, F.lit("/s"), s("user_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", "props", F.concat(grp, F.lit("/frames/"), s("event_id"), F.lit(".jpg")).alias("path"), (F.col("event_type") == "error").cast("int").alias("label"), src.alias("dataset"), grp.alias("grp"), (F.col("value") / 500.0).alias("score"))


def line_id():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (F.col("o_orderstatus") == "F").cast("int")
    score = F.round(F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("l_quantity") / 50.0 * 0.6 + 0.2 * label + F.col("l_discount"))), 3)
    zone = F.when(F.col("l_returnflag") == "N", "interior").when(F.col("l_returnflag") == "R", "edge").otherwise("exterior")
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(line_id().alias("patch_id"), F.concat(F.lit("/lake/docs/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("source_path"), zone.alias("zone"), label.alias("label"), score.alias("score"), F.col("l_linenumber").alias("line"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = F.concat(F.lit("["), F.concat_ws(",", q, n, q + F.col("l_partkey") % 900, n + F.col("l_suppkey") % 600), F.lit("]"))
    kind = F.col("l_orderkey") % 50
    bbox = F.when(kind == 0, "").when(kind == 1, "nan").when(kind == 2, "[1,2]").when(kind == 3, "[5,5,5,9]").otherwise(text)
    return table(spark, sf_dir, "lineitem").select(line_id().alias("id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_returnflag") == "R").cast("int").alias("label"), bbox.alias("bbox"), F.col("l_quantity").alias("x1"), n.cast("double").alias("y1"), (F.col("l_quantity") + F.col("l_partkey") % 900).alias("x2"), (n + F.col("l_suppkey") % 600).cast("double").alias("y2"), kind.alias("kind"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    own = W.partitionBy("o_custkey")
    name = F.concat_ws("-", F.lit("job"), F.col("o_custkey") % 10, "o_custkey")
    out = table(spark, sf_dir, "orders").select(name.alias("run"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")).alias("epoch"), (F.col("o_totalprice") / 10000).alias("val_eer"), F.count("*").over(own).alias("n_epochs"))
    return out.where("n_epochs >= 3")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("media_id"), F.when(k % 3 == 0, None).when(k % 7 == 0, k + 1000000).otherwise(k - 1).alias("source_media_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("label")
    role = F.when(n <= 1, "prod").when(n <= 6, "train").when(n == 7, "test").otherwise("candidate")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("d"), n.cast("string")).alias("domain"), role.alias("role"), (F.col("vec_id") % 2).cast("int").alias("label"), F.concat(F.lit("g"), F.floor(F.col("vec_id") / 3).cast("string")).alias("grp"))
