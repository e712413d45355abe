"""Leak pairs and files, scans that stop, and quick box parsing."""

import json
import random

from pyspark.sql import functions as F

from tallyforge.functions import boxes
from tallyforge.operators import audit, relating
from tallyforge.sources import manifests


def test_leaks(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(30)]
    near = [h ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for h in base[:10]]
    rows = [(f"{split}/{i}.jpg", f"{split}-s{i % 3}", rng.choice(pool)) for split, pool in (("train", base[:20] + [None]), ("test", base[15:] + near)) for i in range(120)]
    rows += [(f"train/hot{i}.jpg", "train-s0", base[0]) for i in range(200)]
    df = spark.createDataFrame(rows, "file string, session string, h long").repartition(3)
    train, test = df.where("file LIKE 'train%'"), df.where("file LIKE 'test%'")
    a, b = ([r for r in rows if r[0].startswith(s) and r[2] is not None] for s in ("train", "test"))
    for most in (None, 3):
        pairs = relating.leaking(train, test, "h", "file", "session", most).collect()
        want = {}
        for fa, sa, ha in a:
            for fb, sb, hb in b:
                d = bin(ha ^ hb).count("1")
                if d == 0 or (most is not None and d <= most):
                    x = want.setdefault((ha, hb), [d, set(), set()])
                    x[1].add((fa, sa))
                    x[2].add((fb, sb))
        got = {(r["train_hash"], r["test_hash"]): [r["distance"], r["n_train"], r["n_test"], (r["train_file"], r["train_session"]), (r["test_file"], r["test_session"])] for r in pairs}
        assert len(pairs) == len(got) and got == {k: [d, len(x), len(y), min(x), min(y)] for k, (d, x, y) in want.items()} and got
        assert {r["type"] for r in pairs} == ({"exact"} if most is None else {"exact", "near"})
        files = relating.leaking_files(train, test, spark.createDataFrame(pairs), "h", "file", "session", 4).collect()
        expected = set()
        for (ha, hb), (d, x, y) in want.items():
            kind = "near" if d else "exact"
            for split, own, h in (("train", x, ha), ("test", y, hb)):
                partners = [v[0] for k, v in want.items() if k[split == "test"] == h and (v[0] > 0) == (d > 0)]
                expected |= {(kind, split, s, f, h, min(partners), len(partners)) for f, s in own}
        assert len(files) == len(expected) and set(map(tuple, files)) == expected
    none = relating.leaking(train.where("1 = 0"), test, "h", "file", "session", 3)
    assert none.count() == 0 and relating.leaking_files(train, test, none, "h", "file", "session").count() == 0


def test_scan_stops(spark, tmp_path):
    files = []
    for n in range(9):
        path = tmp_path / f"part-{n}.csv"
        path.write_text("path,bbox\n" + "".join(f"p{n}-{i},{'bad' if n >= 1 and i % 10 == 3 else ''}\n" for i in range(40)))
        files.append(str(path))
    opened = []

    def load(some):
        opened.extend(some)
        return spark.read.option("header", True).csv(some)

    status = boxes.error_class(F.col("bbox"))
    bad, totals = audit.scan_until(files, load, status, 10)
    assert [(r["path"], r["status"]) for r in bad.collect()] == [(f"p{n}-{i}", "not_a_list") for n in (1, 2, 3) for i in (3, 13, 23, 33)][:10]
    assert opened == files[:7] and totals == {"ok": 0, "empty": 7 * 40 - 24, "rows": 280, "files": 7}  # the last two stay unread
    every, totals = audit.scan_until(files, load, status, 1000, first=4)
    assert every.count() == 32 and totals["files"] == 9 and totals["rows"] == 360
    assert manifests


def test_quick_boxes_are_the_parsed_ones(spark):
    rng = random.Random(2)
    number = lambda: rng.choice(["0", "-0", "01", "1", "12.50", "-3.25", "1e2", ".5", "5.", "+4", "123456789012345", "1234567890123456", "NaN", '"7"', "null", "", " 8", "9 ", "0.1234567890123456"])
    texts = ["[" + rng.choice([",", ", ", " ,"]).join(number() for _ in range(rng.choice([4, 4, 4, 4, 3, 5]))) + rng.choice(["]", " ]", "] ", ""]) for _ in range(3000)]
    plain = ["0", "-0", "1", "12.50", "-3.25", "123456789012345", "9"]
    texts += ["[" + rng.choice([",", ", "]).join(rng.choice(plain) for _ in range(4)) + "]" for _ in range(300)]
    texts += ["[1,2,3,4]", "[1, 2, 3, 4]", " [1,2,3,4]", "[3,2,1,4]", "[ 1,2,3,4 ]", "[1,2,3,4]]", "[1,2,3,4,]", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = boxes.parsed(F.concat(F.lit("  "), F.col("t")))  # white space before: never quick
    got = df.select("t", boxes.parsed(F.col("t")).alias("a"), slow.alias("b"), F.col("t").rlike(boxes.PLAIN).alias("q")).collect()
    assert all(r["a"] == r["b"] for r in got), [r for r in got if r["a"] != r["b"]][:3]
    assert sum(bool(r["q"]) for r in got) > 20
    for r in got:
        if r["q"]:
            x = [float(v) for v in json.loads(r["t"])]
            assert r["a"]["box"] == (x if x[2] > x[0] and x[3] > x[1] else None)


def test_selected_quantiles(spark):
    import numpy as np

    from tallyforge.operators import aggregates, metrics

    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i % 3, rng.choice([None, float("nan"), round(rng.random(), 2), rng.gauss(0, 5)])) for i in range(900)] + [("one", 0, 4.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, m int, x double").repartition(3)
    points = [0.0, 0.05, 0.5, 0.9, 1.0]
    small = metrics.PER_BUCKET
    try:
        for per in (small, 40):
            metrics.running.__defaults__ = (per,)
            for keys in ([], ["k"], ["k", "m"]):
                got = {tuple(r[c] for c in keys): (r["q"], r["n"]) for r in aggregates.selected(df, "x", points, keys).collect()}
                want = {}
                for k, m, x in rows:
                    if x is not None and x == x:
                        want.setdefault(tuple({"k": k, "m": m}[c] for c in keys), []).append(x)
                assert set(got) == set(want)
                for key, x in want.items():
                    assert got[key][1] == len(x) and np.allclose(got[key][0], np.quantile(x, points))
    finally:
        metrics.running.__defaults__ = (small,)
    assert aggregates.selected(df.where("1 = 0"), "x", points, ["k"]).count() == 0
