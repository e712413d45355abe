"""Mining hard rows as one job: sections by hardness, weights by likeness to production, buckets by clusters, picks under two caps, and a control."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.keyed import gumbel, shuffle_key, uniform
from tallyforge.functions.scores import band_weight, hardness, section
from tallyforge.operators import audit, probes, sampling, vectors
from tallyforge.sources.staging import staged


def likeness(pool: DataFrame, prod: DataFrame, key: str, vector: str, prod_max: int = 5000, k: int = 5, c: float = 0.1, low: float = 0.1, high: float = 10.0, seed: int | str = 42) -> DataFrame:
    """key, prod_weight: how much a pool row looks like production: cross-fitted odds over their median, held to [low, high].

    Vectors are scaled to mean 0 and deviation 1 over both sides; the fits are balanced and never see the row that they score. Production is cut to
    prod_max rows in keyed order (a bounded sample). Without production rows all weights are 1.
    """
    side = lambda t, y: t.select(F.col(key).cast("string").alias("k"), F.lit(y).alias("y"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    both = staged(side(pool, 0).unionByName(side(sampling.first(prod, prod_max, key, seed), 1)), "likeness")
    if both.where("y = 1").isEmpty() or both.where("y = 0").isEmpty():
        return pool.select(key, F.lit(1.0).alias("prod_weight"))
    scaled = vectors.standardised(both, "v").withColumn("c", F.lit("pool")).withColumn("g", F.concat_ws("|", "y", "k"))
    data = staged(sampling.balanced_folds(scaled, "g", k, "y", ["c"], seed), "likeness-folds")
    p = probes.out_of_fold(data, probes.fitted(data, k, c)).where("y = 0").select("k", F.least(F.greatest("p", F.lit(1e-4)), F.lit(1 - 1e-4)).alias("p"))
    weights = vectors.odds_weights(p, "p", low, high).select("k", F.col("weight").alias("prod_weight"))
    return pool.select(key).join(weights, F.col(key).cast("string") == F.col("k")).drop("k")


def buckets(rows: DataFrame, key: str, vector: str, clusters: int, dims: int = 50, seed: int = 42) -> DataFrame:
    """key, bucket: k-means clusters of the rows' first dims principal components."""
    wide = rows.select(F.max(F.size(vector)).alias("d"), F.count("*").alias("n")).first()
    if not wide["n"]:
        return rows.select(key, F.lit(0).alias("bucket"))
    reduced = vectors.centred_pca(rows, sampling.first(rows, 20_000, key, seed), max(1, min(dims, wide["d"])), vector)[0]
    return vectors.kmeans(reduced, max(1, min(clusters, wide["n"])), "z", seed).select(key, F.col("cluster").alias("bucket"))


def mine(pool: DataFrame, prod: DataFrame | None, n: int, key: str, group: str, score: str = "score", label: str = "label", vector: str | None = "embedding", low: float = 0.6, high: float = 0.95, clusters: int = 30, per_group: int = 3, bucket_share: float = 0.1, seed: int | str = 42) -> DataFrame:
    """pool's rows with hardness, pct, section (easy, band, noise), prod_weight, bucket (band rows), picked and control.

    The pool is of one label. picked: n rows of the band by Gumbel keys of the band's ramp times prod_weight, at most per_group of a group and the rounded-up
    bucket_share of n of a bucket, as a walk in that order takes them. control: as many rows of the whole pool in keyed random order, under
    the same cap of groups. section noise is the review list. Without vectors there are one bucket without a cap and no weights. Keys are distinct
    and not null. Building the result runs the jobs of the fits and rounds.
    """
    rows = pool.withColumn("hardness", hardness(F.col(label), F.col(score))).withColumn("_all", F.lit(0))
    rows = audit.percentile_rank(rows, ["_all"], "hardness", key).drop("_all").withColumn("section", section(F.col("pct"), low, high))
    rows = staged(rows.select(*pool.columns, "hardness", "pct", "section"), "mining")
    band = rows.where("section = 'band'")
    weights = likeness(pool, prod, key, vector, seed=seed) if vector and prod is not None else rows.select(key, F.lit(1.0).alias("prod_weight"))
    found = buckets(band, key, vector, clusters) if vector else band.select(key, F.lit(0).alias("bucket"))
    rows = staged(rows.join(weights, key, "left").join(found, key, "left"), "mining")
    ordered = rows.where("section = 'band'").withColumn("_w", band_weight(F.col("pct"), low, high) * F.col("prod_weight"))
    ordered = ordered.select(key, group, "bucket", (-gumbel(F.greatest("_w", F.lit(1e-12)), uniform(seed, F.col(key)))).alias("_o"))
    cap = max(1, math.ceil(bucket_share * n)) if vector else n
    picked = staged(sampling.two_caps(ordered, ["_o", key], group, per_group, "bucket", cap, n).select(key, F.lit(True).alias("picked")), "picked")
    by_group = W.partitionBy(group).orderBy("_c", key)
    random = rows.withColumn("_c", shuffle_key("control", F.col(key))).withColumn("_n", F.row_number().over(by_group)).where(F.col("_n") <= per_group)
    control = random.orderBy("_c", key).limit(picked.count()).select(key, F.lit(True).alias("control"))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("picked", "control")}
    return rows.join(picked, key, "left").join(control, key, "left").withColumns(flags)


def summary(mined: DataFrame, group: str, score: str = "score") -> DataFrame:
    """One row: rows by section, picked and control rows, groups picked, the largest bucket's share, mean scores of both arms."""
    arm = F.col("picked")
    largest = mined.where(arm).groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    counts = [F.count_if(F.col("section") == s).alias(s) for s in ("easy", "band", "noise")]
    whole = mined.agg(F.count("*").alias("pool"), *counts, F.count_if(arm).alias("picked"), F.count_if("control").alias("control"), F.count_distinct(F.when(arm, F.col(group))).alias("picked_groups"), F.avg(F.when(arm, F.col(score))).alias("mean_score_picked"), F.avg(F.when(F.col("control"), F.col(score))).alias("mean_score_control"))
    return whole.withColumn("largest_bucket_share", F.coalesce(largest.scalar(), F.lit(0)) / F.greatest("picked", F.lit(1)))
