"""The exact neighbour join with pivots, against brute force."""

import numpy as np
import pytest

from tallyforge.operators import vectors


def table(spark, x, groups):
    rows = [(i, g, [float(a) for a in v]) for i, (v, g) in enumerate(zip(x, groups, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, grp string, embedding array<double>")


def brute(x, groups, queries, k):
    out = set()
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        others = [i for i in range(len(x)) if groups[i] != groups[q]]
        for rank, i in enumerate(sorted(others, key=lambda i: (d[i], i))[:k], 1):
            out.add((q, rank, i))
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    if kind == "clusters":
        x = x * 0.05 + rng.normal(size=(20, 6))[rng.integers(0, 20, 600)] * 10
    if kind == "copies":
        x[: 300] = x[0]
    groups = [f"g{i // 3}" for i in range(600)]
    df = table(spark, x, groups).repartition(3)
    queries = list(range(0, 600, 7))
    compared = []
    got = vectors.neighbours(df.where("vec_id % 7 = 0"), df, 5, per_pivot=30, compared=compared)
    assert {(r["query_id"], r["rank"], r["neighbour_id"]) for r in got.collect()} == brute(x, groups, queries, 5)
    assert compared[1] == len(queries) * 600 and compared[0] <= compared[1]
    if kind == "clusters":
        assert compared[0] < 0.3 * compared[1]


def test_neighbours_with_few_rows(spark):
    x, groups = np.arange(8.0).reshape(8, 1), ["a", "a", "a", "a", "b", "b", "c", None]
    df = table(spark, x, groups)
    got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in vectors.neighbours(df, df.where("vec_id < 6"), 4, per_pivot=2).collect()}
    assert [got.get((0, i)) for i in (1, 2, 3)] == [4, 5, None] and [got.get((5, i)) for i in (1, 2, 3, 4)] == [3, 2, 1, 0]
    assert vectors.neighbours(df, df.where("1 = 0"), 4).count() == 0 and vectors.neighbours(df.where("1 = 0"), df, 4).count() == 0


def test_neighbours_among_many_copies(spark):
    """Ties go to the smaller id, whatever the number of copies and of vectors at one distance."""
    rng = np.random.default_rng(6)
    copy = rng.normal(size=8)
    ids = [int(i) for i in rng.permutation(400)]
    rows = [(i, f"g{i % 3}" if i < 100 else f"own{i}", copy) for i in ids[:200]] + [(i, f"h{i}", rng.normal(size=8) + 9) for i in ids[200:]]
    # 64 different vectors at one distance from the query 1000
    rows += [(2000 + i, f"e{i}", 1000.0 + np.array([1.0 if i >> b & 1 else -1.0 for b in range(6)] + [0.0, 0.0])) for i in rng.permutation(64)]
    asked = [(1000, "q", np.full(8, 1000.0)), (1001, "g0", copy), (1002, "q", copy + 0.1)]
    frame = lambda r: spark.createDataFrame([(int(i), g, v.tolist()) for i, g, v in r], "vec_id long, grp string, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["neighbour_id"]) for r in vectors.neighbours(frame(asked), frame(rows), 5).collect())
    want = []
    for q, g, v in asked:
        best = sorted((float(((x - v) ** 2).sum()), i) for i, h, x in rows if h != g)[:5]
        want += [(q, n + 1, int(i)) for n, (_, i) in enumerate(best)]
    assert got == sorted(want)
