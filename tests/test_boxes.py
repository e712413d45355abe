"""Queries over boxes against their SQL on rows that the smallest tables lack."""

import duckdb

from tallyforge.plans import catalog, columns  # noqa: F401


def test_fills_frame_at_the_right_edge(spark, tmp_path):
    """A frame of 500: right edges from 480 to 489 don't reach its last fiftieth, 490 does."""
    found = [(100 + x, 1, x - 10, 399, 10.0, "N", "O") for x in (479, 480, 485, 489, 490, 491)]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(50 * k + 4, *rest) for k, *rest in found], kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["g18_fills_frame"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = set(con.sql(catalog.ORACLES["g18_fills_frame"]).fetchall())
    assert got == want and sorted(fills for _, fills in got) == [False] * 4 + [True] * 2
