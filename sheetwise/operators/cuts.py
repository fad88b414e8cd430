"""Cutting long plans: a table in the folder that all executors share; joins that send no table to the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the cluster names; in local mode a temporary one stands in where none is set.

    Files stay until that folder is cleared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-cuts-")
    return f"{base.rstrip('/')}/sheetwise-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, for plans that use one result many times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """`df` to be joined by shuffling both sides, so that nothing is gathered in the driver.

    Spark takes exploded rows for as small as what they are made from, and written ones for as small as their files; it
    would broadcast tables of any number of rows.
    """
    return df.hint("merge")
