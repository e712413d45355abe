"""The two-cap walk and mining, against plain walks."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.keyed import gumbel, shuffle_key, uniform
from tallyforge.functions.scores import band_weight
from tallyforge.operators import mining, sampling


def walk(rows, cap_group, cap_bucket, n):
    """rows: (order, id, group, bucket), taken one after the other."""
    groups, buckets, out = Counter(), Counter(), []
    for _, i, g, b in sorted(rows, key=lambda r: r[:2]):
        if len(out) == n:
            break
        if groups[g] < cap_group and buckets[b] < cap_bucket:
            groups[g] += 1
            buckets[b] += 1
            out.append(i)
    return set(out)


@pytest.mark.parametrize("n", [None, 7, 60])
def test_two_caps(spark, n):
    rng = random.Random(n or 1)
    rows = [(round(rng.random(), 2), i, rng.choice([None, "hot", "hot", f"g{rng.randrange(30)}"]), rng.choice([None, 1, 1, 1, rng.randrange(2, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "o double, id long, grp string, bucket int")
    for caps in ((2, 5), (1, 1), (40, 3)):
        got = sampling.two_caps(df.repartition(3), ["o", "id"], "grp", caps[0], "bucket", caps[1], n)
        assert got.columns == df.columns
        assert {r["id"] for r in got.collect()} == walk(rows, *caps, n)


def test_two_caps_edges(spark):
    df = spark.createDataFrame([(0.5, 1, "a", 1)] * 4, "o double, id long, grp string, bucket int")
    assert sampling.two_caps(df.where("1 = 0"), ["o", "id"], "grp", 1, "bucket", 1, 5).count() == 0
    assert sampling.two_caps(df, ["o", "id"], "grp", 3, "bucket", 9).count() == 3  # equal rows count each
    assert sampling.two_caps(df, ["o", "id"], "grp", 0, "bucket", 9).count() == 0


def pool(spark, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, f"s{i % 40}", 1, float(rng.random()), [float(x) for x in rng.normal(size=6) + (3 if i % 4 == 0 else 0)]) for i in range(400)]
    prod = [(1000 + i, "p", 1, float(rng.random()), [float(x) for x in rng.normal(size=6) + 3]) for i in range(100)]
    kind = "vec_id long, grp string, label int, score double, embedding array<double>"
    return spark.createDataFrame(rows, kind), spark.createDataFrame(prod, kind)


def test_mining_is_the_plain_walk(spark):
    rows, prod = pool(spark)
    mined = mining.mine(rows.repartition(3), prod, 40, "vec_id", "grp", clusters=6, per_group=2, bucket_share=0.3)
    got = [r.asDict() for r in mined.collect()]
    assert len(got) == 400
    by_hardness = sorted(got, key=lambda r: (1 - r["score"], r["vec_id"]))
    for place, r in enumerate(by_hardness):
        assert abs(r["hardness"] - (1 - r["score"])) < 1e-12 and abs(r["pct"] - place / 399) < 1e-9
        assert r["section"] == ("noise" if place / 399 > 0.95 else "band" if place / 399 >= 0.6 else "easy")
        assert (r["bucket"] is not None) == (r["section"] == "band")
    # what looks like production weighs more
    alike, other = ([r["prod_weight"] for r in got if (r["vec_id"] % 4 == 0) == x] for x in (True, False))
    assert min(alike) > 5 * max(1e-9, np.median(other)) or np.median(alike) == 10.0
    assert all(0.1 <= w <= 10 for w in alike + other)
    keys = mined.where("section = 'band'").select("vec_id", (-gumbel(F.greatest(band_weight(F.col("pct"), 0.6, 0.95) * F.col("prod_weight"), F.lit(1e-12)), uniform(42, F.col("vec_id")))).alias("o"))
    order = {r["vec_id"]: r["o"] for r in keys.collect()}
    want = walk([(order[r["vec_id"]], r["vec_id"], r["grp"], r["bucket"]) for r in got if r["section"] == "band"], 2, math.ceil(0.3 * 40), 40)
    assert {r["vec_id"] for r in got if r["picked"]} == want and len(want) > 20
    random_order = {r["vec_id"]: r["c"] for r in rows.select("vec_id", shuffle_key("control", F.col("vec_id")).alias("c")).collect()}
    assert {r["vec_id"] for r in got if r["control"]} == walk([(random_order[r["vec_id"]], r["vec_id"], r["grp"], 0) for r in got], 2, 10**9, len(want))
    one = mining.summary(mined, "grp").first()
    assert (one["pool"], one["picked"], one["control"]) == (400, len(want), len(want)) and one["noise"] == sum(r["section"] == "noise" for r in got)


def test_mining_without_vectors(spark):
    rows, _ = pool(spark)
    got = mining.mine(rows, None, 30, "vec_id", "grp", vector=None, per_group=1).collect()
    assert {r["prod_weight"] for r in got} == {1.0} and sum(r["picked"] for r in got) == 30 == sum(r["control"] for r in got)
    assert mining.mine(rows.where("1 = 0"), None, 30, "vec_id", "grp", vector=None).count() == 0


def test_likeness_without_production(spark):
    rows, prod = pool(spark)
    assert {r["prod_weight"] for r in mining.likeness(rows, prod.where("1 = 0"), "vec_id", "embedding").collect()} == {1.0}
