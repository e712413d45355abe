"""Probes, balanced folds and the parts of the domain report, against plain numpy and hand-made tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyforge.operators import domain_report, probes, sampling


def vectors(spark, seed=3):
    """Two labels; cells a (apart from production), b (like it), small (19 rows), few (three groups only)."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for domain, n, shift, groups in (("p", 70, 0.0, 40), ("a", 60, 3.0, 30), ("b", 90, 0.2, 45), ("small", 19, 1.0, 19), ("few", 40, 0.5, 3)):
            for i in range(n):
                v = rng.normal(size=5) + shift * np.array([1, 0, 0, -1, 0])
                rows.append((len(rows), domain, label, "prod" if domain == "p" else "pool", f"{domain}{label}-{i % groups}", [float(x) for x in v]))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "vec_id long, domain string, label int, role string, grp string, embedding array<double>")


def plain_fit(x, y, c=1.0):
    """A balanced logistic fit with a free constant, by many small Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge, w = np.diag([1 / c] * (x.shape[1] - 1) + [0]), np.zeros(x.shape[1])
    for _ in range(2000):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - 0.3 * np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (s * (p - y)) + ridge @ w)
    return w


def plain_auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_probes_of_all_cells(spark):
    rows = vectors(spark)
    _, data = probes.pairs(rows, ["domain", "label"], F.col("role") == "prod", "label", "embedding", "grp", "vec_id", 50, 20, 5, 42)
    got = {(r["domain"], r["label"]): r for r in probes.cell_probes(rows.repartition(3), ["domain", "label"], F.col("role") == "prod", "label", side_cap=50).collect()}
    assert {k: r["n"] for k, r in got.items()} == {(d, y): n for d, n in (("a", 60), ("b", 90), ("small", 19), ("few", 40)) for y in (0, 1)}
    assert all((r["auc"] is None) == (k[0] == "small") for k, r in got.items())
    pdf = data.toPandas()
    assert pdf.groupby("c")["y"].sum().eq(50).all()
    for cell, own in pdf.groupby("c"):
        x, y, fold = np.stack(own["v"]), own["y"].to_numpy(), own["fold"].to_numpy()
        score = np.zeros(len(y))
        for f in range(5):
            score[fold == f] = np.c_[x, np.ones(len(x))][fold == f] @ plain_fit(x[fold != f], y[fold != f])
        key = tuple(pd.io.json.ujson_loads(cell).values())
        assert abs(got[key]["auc"] - plain_auc(score, y)) < 1e-3
        if key[0] != "few":  # groups stay whole; "few" has too few of them
            assert own.groupby("g")["fold"].nunique().max() == 1
    assert got["a", 0]["auc"] > 0.95 > 0.7 > got["b", 1]["auc"]


def test_probes_take_the_whole_side(spark):
    """A side of 1,700 rows counts whole, in the fits and in the AUC."""
    rng = np.random.default_rng(8)
    of = [("p", 1_700, 0.0), ("a", 50, 0.7)]
    rows = [(d, [float(x) for x in rng.normal(size=3) + shift]) for d, n, shift in of for _ in range(n)]
    rows = spark.createDataFrame([(i, d, 1, f"g{i}", v) for i, (d, v) in enumerate(rows)], "vec_id long, domain string, label int, grp string, embedding array<double>")
    side = F.col("domain") == "p"
    got = probes.cell_probes(rows, ["domain", "label"], side, "label").collect()
    own = probes.pairs(rows, ["domain", "label"], side, "label", "embedding", "grp", "vec_id", 1_700, 20, 5, 42)[1].toPandas()
    x, y, fold = np.stack(own["v"]), own["y"].to_numpy(), own["fold"].to_numpy()
    assert np.bincount(y).tolist() == [50, 1_700]
    score = np.zeros(len(y))
    for f in range(5):
        score[fold == f] = np.c_[x, np.ones(len(x))][fold == f] @ plain_fit(x[fold != f], y[fold != f])
    assert [r["n"] for r in got] == [50] and abs(got[0]["auc"] - plain_auc(score, y)) < 1e-5


def test_probe_weights_are_the_optimum(spark):
    """The gradient is zero at the weights, for separable cells too."""
    rows = vectors(spark).where("domain IN ('p', 'a')").withColumn("embedding", F.transform("embedding", lambda x: x * F.when(F.col("domain") == "a", 9.0).otherwise(0.1)))
    _, data = probes.pairs(rows, ["domain", "label"], F.col("role") == "prod", "label", "embedding", "grp", "vec_id", 1500, 20, 5, 42)
    weights = probes.fitted(data, 5, 1.0)
    pdf = data.toPandas()
    for cell, own in pdf.groupby("c"):
        for f in range(5):
            seen = own[own["fold"] != f]
            x, y = probes.design(seen["v"]), seen["y"].to_numpy()
            s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))[:, None]
            _, gradient, _ = probes.logistic_sums(x, y, s, weights[cell][[f]])
            assert np.abs(gradient[0] + np.r_[weights[cell][f][:-1], 0]).max() < 1e-6


def test_probes_of_nothing(spark):
    rows = vectors(spark)
    args = (["domain", "label"], F.col("role") == "prod", "label")
    assert probes.cell_probes(rows.where("1 = 0"), *args).count() == 0
    alone = probes.cell_probes(rows.where("role <> 'prod'"), *args).collect()
    assert len(alone) == 8 and all(r["auc"] is None for r in alone)


def test_balanced_folds(spark):
    rng = random.Random(1)
    rows = []
    for g in range(300):
        kind = rng.random()
        size = 60 if kind < 0.03 else rng.randrange(1, 8)
        rows += [(len(rows) + i, f"g{g}", int(rng.random() < (0.1 if kind < 0.5 else 0.7)), "xy"[g % 2]) for i in range(size)]
    rows += [(10_000 + i, f"one{i}", i % 2, "x") for i in range(400)]  # a class with very many groups
    df = spark.createDataFrame(rows, "id long, grp string, label int, part string")
    for by in ([], ["part"]):
        got = sampling.balanced_folds(df.repartition(3), "grp", 5, "label", by).collect()
        assert len(got) == len(rows) and {r["fold"] for r in got} == set(range(5))
        again = {r["id"]: r["fold"] for r in sampling.balanced_folds(df.repartition(7), "grp", 5, "label", by).collect()}
        assert all(again[r["id"]] == r["fold"] for r in got)
        fold_of, count, largest = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
        for r in got:
            part = r["part"] if by else ""
            fold_of[part, r["grp"]].add(r["fold"])
            count[part, r["label"]][r["fold"]] += 1
            largest[part][r["grp"]] += 1
        assert all(len(f) == 1 for f in fold_of.values())
        for (part, _), n in count.items():  # folds differ by one group's size at most
            assert max(n.values()) - min(n.values()) <= max(largest[part].values())
    dealt = sampling.dealt(pd.DataFrame({"n0": [1, 40], "n1": [0, 2], "m": [1_000_003, 3]}), 5)
    small, big = dealt[dealt["n0"] == 1].iloc[0], dealt[dealt["n0"] == 40].iloc[0]
    assert small["base"] == 200_000 and len(small["rest"]) == 3 and big["base"] == 0 and len(set(big["rest"])) == 3 and set(range(5)) - set(big["rest"]) <= set(small["rest"])


def test_production_errors(spark):
    rows = [(i, "prod", i % 2, s) for i, s in enumerate([0.1, 0.9, 0.2, 0.8, 0.3, 0.25, 0.6, 0.7])] + [(20, "train", 1, 0.2), (21, "train", 0, 0.95), (22, "train", 0, None), (23, "train", 0, float("nan")), (24, "train", 1, 0.99)]
    df = spark.createDataFrame(rows, "id long, role string, label int, score double")
    got = {r["id"]: r["error"] for r in domain_report.production_errors(df, F.col("role") == "prod").collect()}
    attack, live = [s for _, r, y, s in rows if r == "prod" and y == 1], [s for _, r, y, s in rows if r == "prod" and y == 0]
    best = min(sorted(attack + live), key=lambda t: (round(abs(np.mean([a < t for a in attack]) - np.mean([x >= t for x in live])), 9), t))
    assert got == {i: None if s is None or s != s else (s < best if y == 1 else s >= best) for i, _, y, s in rows}
    one = domain_report.production_errors(df.where("label = 1"), F.col("role") == "prod").collect()
    assert len(one) == 6 and all(r["error"] is None for r in one)


def test_cells_and_overlaps(spark):
    affinity = spark.createDataFrame([("a", "a", 2.0), ("a", "b", 1.0), ("a", "c", 1.0), ("a", "d", 3.0), ("a", "e", -1.0), ("b", "b", 0.5)], "src string, dst string, log_lift double")
    got = {r["cell"]: (r["self_lift"], r["nearest"]) for r in domain_report.nearest_cells(affinity).collect()}
    assert got == {"a": (2.0, ["d", "b", "c"]), "b": (0.5, [])}
    rows = spark.createDataFrame([("x", "s1", 1), ("x", "s2", 2), ("x", "s2", 2), ("x", "s3", 3), ("y", "s3", 3), ("y", "s2", 2), ("z", "s1", 1), (None, "s1", 1), (None, "s2", 2)], "path string, source string, place int")
    assert sorted(map(tuple, domain_report.overlaps(rows, "path", "source", "place").collect())) == [("s1", "s2", 1), ("s1", "s3", 1), ("s2", "s3", 1)]


def test_breakdown_and_findings(spark):
    rows = [(i, i % 2, 0.1 if i < 12 else 1.5, i < 9, "ios" if i % 4 < 2 else "android", "" if i % 3 else "eu", "d1" if i % 5 else "d2") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, coverage double, error boolean, os string, region string, near string")
    got = {(r["meta"], r["value"], r["label"]): r for r in domain_report.breakdown(df, ["os", "region"], "label", "vec_id", "near", support=6).collect()}
    for (meta, value, label), r in got.items():
        own = [x for x in rows if x[1] == label and x[4 if meta == "os" else 5] == value]
        assert (r["n"], r["uncovered"]) == (len(own), sum(x[2] < 0.25 for x in own)) and len(own) >= 6
        assert abs(r["coverage"] - np.mean([min(x[2], 1) for x in own])) < 1e-12 and abs(r["error"] - np.mean([x[3] for x in own])) < 1e-12
        assert r["nearest"] == [k for k, _ in sorted(Counter(x[6] for x in own).items(), key=lambda k: (-k[1], k[0]))][:2]
    assert set(got) == {("os", "ios", 0), ("os", "ios", 1), ("os", "android", 0), ("os", "android", 1), ("region", "eu", 0), ("region", "eu", 1)}
    cells = spark.createDataFrame([("t1", 0, "train", 10, 2.5, 0.995, 0), ("t2", 0, "train", 30, 0.1, 0.4, None), ("t3", 0, "train", 40, 0.2, None, 2), ("c", 1, "candidate", 5, 0.1, 0.99, 7), ("p", 1, "prod", 9, None, None, None)], "domain string, label int, role string, n long, lift double, auc double, delta_covered long")
    shared = spark.createDataFrame([("s1", "s2", 4)], "kept_in string, dropped_from string, n long")
    groups = domain_report.breakdown(df, ["os"], "label", "vec_id", "near", support=6)
    found = {(r["kind"], r["label"], r["subject"]): r["amount"] for r in domain_report.findings(df, cells, groups, shared).collect()}
    assert found["separable", 0, "t1"] == 0.995 and found["separable", 1, "c"] == 0.99 and found["leak", None, "s2 in s1"] == 4
    assert found["collect", 0, "t1"] == 2.5 and found["low", 0, "t2"] == 0.1 and found["candidate", 1, "c"] == 7 and abs(found["coverage", 0, None] - 0.3) < 1e-9
    assert not {k for k in found if k[0] in ("model", "uncovered_group")} and len(found) == 8


def test_the_sample_report_trains_one_probe(spark, monkeypatch):
    """k09_sample_report scores the samples once, for all its parts."""
    from tallyforge.operators import vectors
    from tallyforge.plans import catalog, reports  # noqa: F401

    trained, transfer = [], vectors.transfer
    monkeypatch.setattr(vectors, "transfer", lambda *a, **k: (trained.append(1), transfer(*a, **k))[1])
    assert "score" in catalog.QUERIES["k09_sample_report"](spark, "/root/testdata/sf0.001").columns and trained == [1]
