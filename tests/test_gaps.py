"""Moments, Frechet distance and gap report against numpy."""

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import gaps


def sides(spark, d=12, shift=1.5, seed=2):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    a, b = 1e3 + rng.normal(size=(140, d)), 1e3 + rng.normal(size=(90, d)) @ mix + shift  # far from zero: sums must not lose it
    rows = [(i, i % 2, False, [float(x) for x in v]) for i, v in enumerate(a)] + [(1000 + i, i % 2, True, [float(x) for x in v]) for i, v in enumerate(b)]
    return a, b, spark.createDataFrame(rows, "vec_id long, label int, side boolean, embedding array<double>")


def root_trace(c1, c2):
    """Trace of the root of a product of covariances: its eigenvalues are real and not negative."""
    return np.sqrt(np.maximum(np.linalg.eigvals(c1 @ c2).real, 0)).sum()


def test_moments_and_frechet(spark):
    a, b, df = sides(spark)
    ma, mb = gaps.moments(df.repartition(5), F.col("side"))
    for m, x in ((ma, a), (mb, b)):
        assert m.n == len(x) and np.allclose(m.mean, x.mean(0)) and np.allclose(m.cov, np.cov(x, rowvar=False), atol=1e-8)
        assert abs(m.spread - np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean())) < 1e-8
    for dims in (64, 4):
        both = np.vstack([a, b])
        axes = np.linalg.svd(both - both.mean(0), full_matrices=False)[2][:dims].T
        pa, pb = a @ axes, b @ axes
        want = ((pa.mean(0) - pb.mean(0)) ** 2).sum() + np.trace(np.cov(pa, rowvar=False)) + np.trace(np.cov(pb, rowvar=False)) - 2 * root_trace(np.cov(pa, rowvar=False), np.cov(pb, rowvar=False))
        assert abs(gaps.frechet(ma, mb, dims) - want) < 1e-6 * want


def test_moments_of_nothing(spark):
    _, _, df = sides(spark)
    none, whole = gaps.moments(df.where("side"), F.col("side"))
    assert none.n == 0 and whole.n == 90 and gaps.frechet(none, whole) is None
    assert gaps.moments(df.where("1 = 0"), F.col("side"))[0].n == 0


def test_gap_report(spark):
    a, b, df = sides(spark)
    odd = df.unionByName(spark.createDataFrame([(5000 + i, 7, i % 2 == 0, [1e3] * 12) for i in range(6)], df.schema))
    got = {(r["scope"], r["metric"]): r["amount"] for r in gaps.gap_report(odd, F.col("side"), k=5).collect()}
    assert {scope for scope, _ in got} == {"all", "label 0", "label 1"}  # label 7 has too few rows
    for label in (0, 1):
        pa, pb = a[label::2], b[label::2]
        scope = f"label {label}"
        assert (got[scope, "n_a"], got[scope, "n_b"]) == (len(pa), len(pb))
        assert abs(got[scope, "centroid_dist"] - np.linalg.norm(pa.mean(0) - pb.mean(0)) / np.sqrt(((pa - pa.mean(0)) ** 2).sum(1).mean())) < 1e-8
        both = np.vstack([pa, pb])
        far = ((pb[:, None] - both[None]) ** 2).sum(2)
        far[np.arange(len(pb)), len(pa) + np.arange(len(pb))] = np.inf
        assert abs(got[scope, "knn_cross"] - (np.argsort(far, 1)[:, :5] < len(pa)).mean()) < 1e-9
        assert abs(got[scope, "knn_cross_chance"] - len(pa) / (len(both) - 1)) < 1e-12
        assert 0.6 < got[scope, "domain_auc"] <= 1 and got[scope, "frechet"] > 0
    assert gaps.side_auc(odd.where("label = 7"), F.col("side"), "vec_id", "embedding") is None
