"""The corpus pipeline: documents lose toxic texts, near copies and benchmark leaks, then are mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetwise.llm.common import stored
from sheetwise.llm.decontaminate import stage_decontaminate
from sheetwise.llm.mixing import stage_mix
from sheetwise.llm.sharding import stage_shards
from sheetwise.llm.simhash import stage_near_dedup
from sheetwise.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("sharding", stage_shards),
]

#: A string-kernel machine, fingerprints and alignments can't be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
