"""A worker holds the results of a few images of a batch at a time."""

import numpy as np

from tallyforge.operators import images


def test_results_go_out_before_the_batch_ends(spark):
    """Once a thousand images of one batch are done, the first ones' results are no longer held."""

    class Result(list):
        alive = 0

        def __init__(self, values):
            super().__init__(values)
            Result.alive += 1

        def __del__(self):
            Result.alive -= 1

    def kernel(row):
        return Result([float(Result.alive)]), Result.alive

    data = np.zeros(16, np.uint8).tobytes()
    rows = spark.range(1000, numPartitions=1).selectExpr("id", "4 AS height", "4 AS width").crossJoin(spark.createDataFrame([(bytearray(data),)], "data binary"))
    got = images.each(rows.coalesce(1), kernel, [("values", "array<double>"), ("held", "int")])
    found = got.collect()
    assert sorted(r["id"] for r in found) == list(range(1000)) and all(r["error"] is None for r in found)
    assert max(r["held"] for r in found) <= 2 * images.AT_ONCE + 1


def test_an_empty_batch_stays(spark):
    rows = spark.createDataFrame([], "id long, height int, width int, data binary")
    assert images.each(rows, lambda row: (1,), [("n", "int")]).collect() == []
