"""Keys beyond those of the small scales: rows are still those of the SQL."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def test_consolidate_with_large_suppliers(spark, tmp_path):
    """The document order leaves three digits for a supplier; larger ones carry over into the part."""
    rows = [(1, 1, 7, 2500, 3.0), (1, 1, 8, 4, 1.0), (2, 1, 5, 1000, 2.0), (2, 2, 5, 999, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, queries()["q_consolidate"](spark, str(tmp_path)).collect()))
    want = duckdb.sql(oracle_sql()["q_consolidate"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert got == sorted(want) and [r[2] for r in got] == [8, 6, 5]
