"""What a task of the neighbour search holds, and its parts against brute force."""

import tracemalloc

import numpy as np
import pandas as pd

from tallyforge.operators import vectors


def frame(x, groups, first=0):
    return pd.DataFrame({"id": np.arange(first, first + len(x)), "g": groups, "v": list(x)})


def test_a_task_holds_no_matrix_of_all_its_pairs():
    rng = np.random.default_rng(1)
    a, b = (frame(rng.normal(size=(3000, 8)), [f"g{i // 3}" for i in range(3000)], first) for first in (0, 3000))
    tracemalloc.start()
    found = vectors.nearest_in(a, b, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 15000 and peak < 3000 * 3000 * 8  # a matrix of all pairs has 72 MB


def test_bounds_and_slices():
    rng = np.random.default_rng(2)
    xa, xb = rng.normal(size=(40, 4)), rng.normal(size=(90, 4))
    a, b = frame(xa, [f"g{i}" for i in range(40)]), frame(xb, [f"g{i}" for i in range(90)], 100)
    a["bound"] = [1.0] * 20 + [None] * 20
    b["slice"] = np.arange(90) % 3
    wanted = rng.random((40, 3)) < 0.6
    got = {(r.query_id, r.neighbour_id) for r in vectors.nearest_in(a, b, 4, wanted).itertuples()}
    want = set()
    for i in range(40):
        d = np.sqrt(((xb - xa[i]) ** 2).sum(1))
        own = [j for j in range(90) if i != j and wanted[i, j % 3] and d[j] <= (1.0 if i < 20 else np.inf)]
        want |= {(i, 100 + j) for j in sorted(own, key=lambda j: d[j])[:4]}
    assert got == want


def test_all_values_at_once(spark, monkeypatch):
    """Each value's lists are those of a search in its rows alone; shelves and tasks are small, and a query is copied by shelf, not by block."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    rows = [(i, f"g{i // 3}", "abc"[i % 3] if i % 10 else None, i % 2, x[i].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, grp string, domain string, label int, embedding array<float>")
    monkeypatch.setattr(vectors, "PER_PIVOT", 20)
    monkeypatch.setattr(vectors, "TOGETHER", 60)
    got = {(r["query_id"], r["domain"], r["neighbour_id"]) for r in vectors.neighbours_by(df.where("vec_id % 7 = 0"), df.where("domain IS NOT NULL"), "domain", 3, within="label").collect()}
    want = set()
    for q in range(0, 500, 7):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        for value in "abc":
            own = [i for i in range(500) if i % 10 and "abc"[i % 3] == value and i % 2 == q % 2 and i // 3 != q // 3]
            want |= {(q, value, i) for i in sorted(own, key=lambda i: (d[i], i))[:3]}
    assert got == want


def test_a_task_holds_one_double_of_its_rows():
    """Products are held in single precision: a shelf's rows stand in doubles once, not three times."""
    rng = np.random.default_rng(7)
    n = 20_000
    b = frame(rng.normal(size=(n, 64)).astype(np.float32), [f"g{i // 3}" for i in range(n)])
    a = frame(rng.normal(size=(300, 64)).astype(np.float32), [f"q{i}" for i in range(300)], n)
    tracemalloc.start()
    found = vectors.nearest_in(a, b, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1500 and peak < 3.2 * n * 64 * 8


def test_single_precision_loses_nothing():
    """Far from the origin, of very large and very small size, with one row far out, and with slices cut anywhere: as summed in doubles."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 6))
    far = x.copy()
    far[7] *= 1e9
    for values in (x + 1e7, x * 1e25, x * 1e-25, far, np.round(x)):
        b = frame(values, [f"g{i // 3}" for i in range(1500)])
        b["slice"] = np.arange(1500) // 100
        wanted = rng.random((60, 15)) < 0.7
        got = vectors.nearest_in(b.iloc[:60].drop(columns="slice"), b, 4, wanted)
        want = set()
        for i in range(60):
            d = ((values - values[i]) ** 2).sum(1)
            own = [j for j in range(1500) if j // 3 != i // 3 and wanted[i, j // 100]]
            want |= {(i, j) for j in sorted(own, key=lambda j: (d[j], j))[:4]}
        assert {(r.query_id, r.neighbour_id) for r in got.itertuples()} == want
