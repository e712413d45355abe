"""Edge cases by hand, and properties that hold for any input."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import boxes, paths
from tallyforge.operators import aggregates, audit, batches, images, metrics, relating, sampling, vectors
from tallyforge.sources import manifests, sinks


def scored(spark, pos, neg):
    return spark.createDataFrame([(float(x), 1) for x in pos] + [(float(x), 0) for x in neg], "score double, label int")


def test_eer_edges(spark):
    same = metrics.eer(scored(spark, [0.5] * 4, [0.5] * 4)).first()
    assert same["eer"] == 50
    apart = metrics.eer(scored(spark, [0.7, 0.8], [0.1, 0.2])).first()
    assert apart["eer"] == 0 and apart["eer_threshold"] == 0.7
    row = metrics.metric_row(scored(spark, [0.7], [])).first()
    assert row["eer"] is None and row["bpcer"] is None
    at = metrics.at_threshold(scored(spark, [0.5, 0.6], [0.5, 0.4]), 0.5).first()
    assert at["frr"] == 0 and at["far"] == 0
    nan = scored(spark, [float("nan"), 0.9], [0.1])
    assert metrics.at_threshold(nan, 0.5).first()["n_pos"] == 1


def test_sweep_against_a_walk(spark):
    rng = random.Random(3)
    pos, neg = [round(rng.random(), 2) for _ in range(300)], [round(rng.random() * 0.8, 2) for _ in range(200)]
    got = {r["threshold"]: (r["frr"], r["far"]) for r in metrics.sweep(scored(spark, pos, neg)).collect()}
    for t in sorted({*pos, *neg}):
        assert got[t] == pytest.approx((100 * sum(p < t for p in pos) / 300, 100 * sum(n >= t for n in neg) / 200))
    order = sorted(got)
    assert all(got[a][0] <= got[b][0] and got[a][1] >= got[b][1] for a, b in zip(order, order[1:], strict=False))
    auc = metrics.auc(scored(spark, pos, neg)).first()["auc"]
    assert auc == pytest.approx(1 - metrics.auc(scored(spark, neg, pos)).first()["auc"])


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_partitions_do_not_matter(spark, partitions):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("g"), (F.col("id") % 2).cast("int").alias("label")).repartition(partitions)
    a = sorted(r[0] for r in sampling.capped(rows, ["g"], 5, "id").select("id").collect())
    b = sorted(r[0] for r in sampling.capped(rows.coalesce(1), ["g"], 5, "id").select("id").collect())
    assert a == b and len(a) == 35
    place = sorted(r["place"] for r in sampling.placed(rows, "id").collect())
    assert place == list(range(500))


def test_two_caps_is_the_walk(spark):
    for seed in range(4):
        rng = random.Random(seed)
        data = [(i, rng.randrange(12), rng.randrange(5)) for i in range(150)]
        got = sorted(r["i"] for r in sampling.two_caps(spark.createDataFrame(data, "i long, g int, b int"), ["i"], "g", 3, "b", 6).collect())
        in_g, in_b, want = {}, {}, []
        for i, g, b in data:
            if in_g.get(g, 0) < 3 and in_b.get(b, 0) < 6:
                in_g[g], in_b[b] = in_g.get(g, 0) + 1, in_b.get(b, 0) + 1
                want.append(i)
        assert got == want


def test_allocation(spark):
    deal = lambda ws, n: [r["amount"] for r in sampling.allocation(spark.createDataFrame([(i, float(w)) for i, w in enumerate(ws)], "name int, w double"), "name", "w", n).orderBy("name").collect()]
    assert deal([0.5, 0.5, 0], 8) == [4, 4, 0] and deal([1, 1, 1], 7) == [3, 2, 2]


def test_split(spark):
    rows = spark.createDataFrame([(i, 0) for i in range(20)] + [(99, 1)], "i long, label int")
    got = {(r["label"], r["is_val"]): r["count"] for r in sampling.split(rows, 0.01, "i").groupBy("label", "is_val").count().collect()}
    assert got == {(0, True): 1, (0, False): 19, (1, False): 1}


def test_fair_cap(spark):
    def cap(sizes, budget):
        return sampling.fair_cap(spark.createDataFrame([(s,) for s in sizes], "n long"), "n", budget).first()["cap"]

    for sizes, budget in (([5, 5, 5], 9), ([1, 10, 100], 30), ([3, 3], 100), ([7, 2, 9, 9], 11)):
        want = max(c for c in range(0, 101) if sum(min(s, c) for s in sizes) <= budget)
        assert cap(sizes, budget) == min(want, max(sizes))


def test_covered_batches(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 == 0 else "c", int(i % 3 == 0)) for i in range(300)], "k long, dataset string, label int")
    plan = batches.covered(rows, "k", "dataset", 10).join(rows, "k").collect()
    by = {}
    for r in plan:
        by.setdefault(r["batch_id"], []).append(r)
    assert len(by) == 30
    for own in by.values():
        assert len({r["k"] for r in own}) == len(own) == 10
        assert {r["dataset"] for r in own if r["label"] == 1} == {"a", "b"} and sum(r["label"] for r in own) == 5


def test_source_pairs(spark):
    rows = spark.createDataFrame([(i, (i // 4) * 4 if i % 4 and i < 80 else None, int(i % 4 > 0)) for i in range(200)], "k long, s long, label int")
    plan = batches.source_pairs(rows, "k", "s", 16)
    got = plan.collect()
    by = {}
    for r in got:
        by.setdefault(r["batch_id"], []).append(r["k"])
    assert all(len(v) == len(set(v)) == 16 for v in by.values()) and {r["k"] for r in got} == set(range(200))
    report = batches.pair_report(plan, rows, "k", "s").first()
    assert report["n_linked"] == report["together"] == 60 and report["n_unused"] == 0


def test_box_errors(spark):
    cases = {"": "empty", "None": "empty", "NULL": "empty", "nan": "empty", "[1,2,3]": "size", '{"a":1}': "not_a_list", '["1","2","3","4"]': "ok", "[1,1,1,5]": "degenerate", "[NaN,0,1,1]": "not_finite", "[1,2,x": "not_a_list"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", boxes.error_class(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in rows if r["t"] != "[NaN,0,1,1]"} == {k: v for k, v in cases.items() if k != "[NaN,0,1,1]"}
    assert next(r["e"] for r in rows if r["t"] == "[NaN,0,1,1]") in ("not_finite", "not_a_list")


def test_prefixes(spark):
    df = spark.createDataFrame([("/a/b/x",), ("/a/bc/x",), ("/a/b",)], "p string")
    first = [r[0] for r in df.select(paths.rewritten(F.col("p"), [("/a", "/m"), ("/a/b", "/n")])).collect()]
    longest = [r[0] for r in df.select(paths.longest_rewritten(F.col("p"), [("/a", "/m"), ("/a/b", "/n")])).collect()]
    assert first == ["/m/b/x", "/m/bc/x", "/m/b"] and longest == ["/n/x", "/m/bc/x", "/n"]
    s = spark.createDataFrame([("x/frames/a.jpg",), ("x/Frames/a.jpg",), ("x/images/a.jpg",)], "p string")
    assert [r[0] for r in s.select(paths.session(F.col("p"))).collect()] == ["x", "x", "x/images/a.jpg"]
    assert [r[0] for r in s.select(paths.mining_group(F.col("p"))).collect()] == ["x", "x", "x/images"]


def test_best_epoch_ties(spark):
    rows = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.2), ("r", 3, 0.2), ("r", 4, float("nan"))], "run string, epoch int, m double")
    assert aggregates.best_epoch(rows, "run", "epoch", "m").first()["best_epoch"] == 2
    top = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.5), ("r", 3, 0.1)], "run string, epoch int, m double")
    assert aggregates.best_epoch(top, "run", "epoch", "m", "max").first()["best_epoch"] == 2


def test_near_hashes_miss_nothing(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    other = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(6))) & (2**63 - 1) for b in base]
    got = {(r["train_hash"], r["test_hash"]) for r in relating.near_hashes(spark.createDataFrame([(x,) for x in base], "h long"), spark.createDataFrame([(x,) for x in other], "h long"), 3).collect()}
    assert got == {(a, b) for a in base for b in other if (a ^ b).bit_count() <= 3}


def test_neighbours_short_list(spark):
    rows = spark.createDataFrame([(i, "g" if i < 9 else "h", [float(i), 0.0]) for i in range(10)], "vec_id long, grp string, embedding array<double>")
    got = vectors.neighbours(rows, rows, 3).collect()
    assert [r["neighbour_id"] for r in got if r["query_id"] == 0] == [9]
    assert sorted(r["neighbour_id"] for r in got if r["query_id"] == 9) == [6, 7, 8]


def test_missing_columns(spark):
    with pytest.raises(audit.MissingColumns) as e:
        audit.require(spark.range(1), "id", "path", "label")
    assert e.value.names == ["path", "label"]


def png(grey):
    h, w = grey.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    grey = np.arange(48, dtype=np.uint8).reshape(6, 8)
    (tmp_path / "a.png").write_bytes(png(grey))
    (tmp_path / "b.PNG").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("no")
    assert manifests.image_files(spark, str(tmp_path)).count() == 2
    found = {r["path"][-5:]: r for r in manifests.images(spark, str(tmp_path)).collect()}
    assert found["b.PNG"]["is_bad"] and not found["a.png"]["is_bad"] and found["a.png"]["height"] == 6


def test_bad_image_has_an_error(spark):
    rows = spark.createDataFrame([("x", 2, 2, b"abcd"), ("y", 2, 2, b"abc")], "path string, height int, width int, data binary")
    got = {r["path"]: r for r in images.score(rows, images.linear_model(np.ones((2, 2))), 2).collect()}
    assert got["x"]["error"] is None and got["y"]["score"] is None and "bytes" in got["y"]["error"]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", "1", "[1,2,3,4]", 'x "y"'), (" ", "0", "", "z")], "path string, label string, bbox string, note string")
    path = sinks.write(rows, str(tmp_path / "m"), "csv")
    got = manifests.manifest(spark, path, "/home").collect()
    assert [(r["path"], r["label"], r["bbox"], r["note"]) for r in got] == [("/home/a.jpg", 1, [1.0, 2.0, 3.0, 4.0], 'x "y"')]
    assert sinks.non_empty(rows.where("label = '7'"), str(tmp_path / "none")) is None
