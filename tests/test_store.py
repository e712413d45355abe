"""A store of sources by signature: a second run computes nothing, a changed source alone is written again."""

import os

from tallyforge.sources.store import SignedStore


def test_signed_store(spark, tmp_path):
    store, asked = SignedStore(spark, str(tmp_path / "store"), "source"), []

    def run(signatures, force=False):
        def compute(changed):
            names = sorted(r["source"] for r in changed.collect())
            asked.append(names)
            return spark.createDataFrame([(s, i, signatures[s]) for s in names for i in range(0 if s == "none" else 3)], "source string, i int, made_by string")

        n = store.update(spark.createDataFrame(list(signatures.items()), "source string, signature string"), compute, force)
        rows = {(r["source"], r["i"], r["made_by"]) for r in store.read("i int, made_by string").collect()}
        assert rows == {(s, i, v) for s, v in signatures.items() for i in range(0 if s == "none" else 3)}
        return n

    assert store.read("i int, made_by string").count() == 0
    first = {"a": "1", "b/c =%": "x y", "none": "1", "d": "1"}
    assert run(first) == {"computed": 4, "kept": 0, "removed": 0}
    files = {f for d, _, names in os.walk(tmp_path) for f in names if "part-" in f}
    assert run(first) == {"computed": 0, "kept": 4, "removed": 0} and len(asked) == 1
    assert {f for d, _, names in os.walk(tmp_path) for f in names if "part-" in f} == files
    assert run(first | {"a": "2"}) == {"computed": 1, "kept": 3, "removed": 0} and asked[-1] == ["a"]
    left = {k: v for k, v in first.items() if k != "d"} | {"a": "2"}
    assert run(left) == {"computed": 0, "kept": 3, "removed": 1} and len(asked) == 2
    assert not any("source=d" in d or "signature=1" in d and "source=a" in d for d, _, _ in os.walk(tmp_path))
    assert run(left, force=True) == {"computed": 3, "kept": 0, "removed": 0}


def test_a_run_that_ended_early(spark, tmp_path):
    """Rows without a list aren't seen, and the next run writes them."""
    path = str(tmp_path / "store")
    store = SignedStore(spark, path, "source")
    rows = lambda changed: changed.selectExpr("source", "1 AS i")
    store.update(spark.createDataFrame([("a", "1")], "source string, signature string"), rows)
    spark.createDataFrame([("a", 7, "2"), ("b", 7, "1")], "source string, i int, signature string").write.mode("append").partitionBy("source", "signature").parquet(f"{path}/rows")
    assert [tuple(r) for r in store.read("i int").select("source", "i").collect()] == [("a", 1)]
    n = store.update(spark.createDataFrame([("a", "2"), ("b", "1")], "source string, signature string"), rows)
    assert n == {"computed": 2, "kept": 0, "removed": 0}
    assert sorted(tuple(r) for r in store.read("i int").select("source", "i").collect()) == [("a", 1), ("b", 1)]
