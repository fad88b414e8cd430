"""Every registered query with SQL gives the same rows in Spark and in DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SCALES = ("sf0.001", "sf0.01")
SF = f"/root/testdata/{SCALES[0]}"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for scale in SCALES:
        found[scale] = duckdb.connect()
        for f in glob.glob(f"/root/testdata/{scale}/*.parquet"):
            found[scale].execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return found


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(df):
    df = df.astype(object)[sorted(df.columns)]
    return list(df.columns), sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


#: The larger scale meets values that the smaller one hasn't got.
@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("scale", SCALES)
def test_same_rows(spark, ducks, name, scale):
    assert rows(QUERIES[name](spark, f"/root/testdata/{scale}").toPandas()) == rows(ducks[scale].execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and n.startswith("q_")))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert {r["status"] for r in __spark_entry__.entry(spark).collect()} >= {"changed", "added", "removed", "unchanged"}
