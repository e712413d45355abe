"""Best fit over counts, and source-pair batches."""

import random
from collections import Counter, defaultdict

import pytest

from tallyforge.operators import batches


def test_best_fit_over_counts():
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.randrange(2, 33)
        counts = {size: rng.randrange(1, 60) for size in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity + 1))}
        full, ranks = Counter(), defaultdict(list)
        for size, rank, n, first in batches.best_fit(counts, capacity).tolist():
            for i in range(n):
                full[first + i] += size
                ranks[size].append(rank + i)
        assert max(full.values()) <= capacity and set(full) == set(range(len(full)))
        assert {size: sorted(r) for size, r in ranks.items()} == {size: list(range(n)) for size, n in counts.items()}
        # as good as best fit item by item
        rooms = []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                fits = [r for r in rooms if r >= size]
                if fits:
                    rooms.remove(min(fits))
                    rooms.append(min(fits) - size)
                else:
                    rooms.append(capacity - size)
        assert len(full) <= len(rooms)
    assert len(batches.best_fit({}, 8)) == 0


@pytest.mark.parametrize("free", [0, 40, 900])
def test_source_pairs(spark, free):
    rng = random.Random(free)
    rows, size = [], 16
    for unit in range(60):
        head = len(rows)
        rows.append((head, None, 0))
        rows += [(head + 1 + i, head, 1) for i in range(100 if unit == 3 else rng.randrange(0, 9))]
    rows += [(len(rows) + i, None, int(rng.random() < 0.3)) for i in range(free)]
    df = spark.createDataFrame(rows, "k long, s long, label int").repartition(3)
    got = batches.source_pairs(df, "k", "s", size, batches_a_part=7).collect()
    by, share = defaultdict(list), sum(r[2] for r in rows) / len(rows)
    for r in got:
        by[r["batch_id"]].append(r)
    labels, source = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    assert set(by) == set(range(len(by)))
    assert all(len(v) == size and len({r["k"] for r in v}) == size and sorted(r["slot"] for r in v) == list(range(size)) for v in by.values())
    own = Counter(r["k"] for r in got if not r["repeated"])
    assert set(own) == set(labels)
    heads = Counter(r[1] for r in rows if r[1] is not None)
    assert all(n == (-(-heads[k] // (size - 1)) if k in heads else 1) for k, n in own.items())  # a wide group's source is in each part
    for v in by.values():
        members = {r["k"] for r in v}
        assert all(source[r["k"]] is None or source[r["k"]] in members for r in v if not r["repeated"])
    repeated = sum(r["repeated"] for r in got)
    if free == 900:
        assert repeated < size  # the last batch alone
        mixed = [sum(labels[r["k"]] for r in v) for b, v in by.items() if all(source[r["k"]] is None and r["k"] not in heads for r in v) and not any(r["repeated"] for r in v)]
        assert mixed and max(mixed) - min(mixed) <= 1
    assert len(by) <= -(-len(rows) // size) + (2 if free else 6) + 8 * (free == 0) and 0 < share < 1
    again = batches.source_pairs(df.repartition(5), "k", "s", size, batches_a_part=7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_source_pairs_of_little(spark):
    kind = "k long, s long, label int"
    assert batches.source_pairs(spark.createDataFrame([], kind), "k", "s", 4).count() == 0
    got = batches.source_pairs(spark.createDataFrame([(1, None, 0), (2, 1, 1)], kind), "k", "s", 4).collect()
    assert {r["k"] for r in got} == {1, 2} and len({r["batch_id"] for r in got}) == 1
    only = batches.source_pairs(spark.createDataFrame([(i, None, i % 2) for i in range(10)], kind), "k", "s", 4).collect()
    assert len(only) == 12 and len({r["k"] for r in only}) == 10
