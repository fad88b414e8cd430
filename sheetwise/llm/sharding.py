"""Operator 3: sharding by jump consistent hashing.

Lamping and Veach's walk maps a 64-bit key to one of n shards with no ring table: growing to n + 1 shards moves
a row only into the new shard, and about 1/(n + 1) of all rows move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import globally_ranked, stored, with_places

#: Multiplier of the walk's linear congruential generator (fixed by the published algorithm).
STEP = np.uint64(2862933555777941757)
#: Names of a row's place in a stored table: file, file of the same task, row.
PLACES = ("__sheetwise_file__", "__sheetwise_chunk__", "__sheetwise_place__")

#: Columns of the plan.
PLAN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys walk together until none jumps below `shards`."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    while len(active):
        with np.errstate(over="ignore"):
            state[active] = state[active] * STEP + np.uint64(1)
        ahead = ((shard[active] + 1) * (float(1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        inside = ahead < shards
        active = active[inside]
        shard[active] = ahead[inside]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of any column's value: its 64-bit hash walks. A null key has the hash of null, so all nulls share a shard."""

    @F.pandas_udf("int")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return walk(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, into: str = "shard") -> DataFrame:
    """Add the shard of each row. No shuffle; repeated rows and equal keys share a shard; other columns are kept.

    `shards` must be at least 1. A column already named `into` is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    return df.withColumn(into, shard_of(F.col(key), shards))


def shard_plan(docs: DataFrame, shards: int = 16, order: Sequence[str] = ()) -> DataFrame:
    """One row per document: its shard, its gapless slot there, its shard once one more is added; then `order`.

    Slots follow the columns `order`, if given, then doc_id. Only numbers move: texts are read once, in the scan. Null
    texts have size 1 and the checksum of no bytes (0). Without `order`, null ids come first in their shard and repeated
    ids take neighbouring slots. An empty table gives an empty plan; other columns of the table aren't read.
    """
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(payload).alias("text_crc32"),
        F.lit("key").alias("law"),
        *[F.col(c).alias(f"_order{k}") for k, c in enumerate(order)],
    )
    narrow = stored(assign_shards(assign_shards(narrow, shards=shards), shards=shards + 1, into="grown_shard"))
    first = [F.col(f"_order{k}").asc() for k in range(len(order))]
    ranked = globally_ranked(narrow, "shard", [*first, F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc()], "slot")
    return ranked.select("doc_id", *PLAN, *[F.col(f"_order{k}").alias(c) for k, c in enumerate(order)])


def op3_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents themselves with their place among 16 shards; slots keep the order they come in.

    Texts move once, to their places. Columns named like the plan's are replaced by it; all others are kept. Nulls,
    repeated rows and empty tables are as in shard_plan.
    """
    placed = with_places(docs, PLACES)
    plan = shard_plan(placed.select("doc_id", "text", *PLACES), order=PLACES).drop("doc_id")
    own = [c for c in docs.columns if c not in PLAN]
    return placed.select(*[F.col(f"`{c}`") for c in own], *PLACES).join(plan, list(PLACES)).select(*[F.col(f"`{c}`") for c in own], *PLAN)


#: The same in SQL. crc32 folds bytes through the table of its polynomial; the key is the 64-bit hash of a long, then the walk.
ORACLE_OP3 = """
WITH RECURSIVE polynomial AS (
  SELECT list(v ORDER BY k) AS tab FROM (
    SELECT k, list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v FROM (SELECT unnest(range(256)) AS k))
), d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), c AS (
  SELECT r, doc_id, n + 1 AS size, xor(list_reduce(list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda crc, b: xor(tab[1 + (xor(crc, b) & 255)], crc >> 8), 4294967295), 4294967295) AS text_crc32 FROM d, polynomial
), a0 AS (
  SELECT r, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id END)::UHUGEINT * 14029467366897019727 % 18446744073709551616 AS a FROM d
), a1 AS (
  SELECT r, xor(((a * 2147483648 % 18446744073709551616) + (a >> 33)) * 11400714785074694791 % 18446744073709551616, 2870177450012600311::UHUGEINT) AS a FROM a0
), a2 AS (
  SELECT r, (((a * 134217728 % 18446744073709551616) + (a >> 37)) * 11400714785074694791 + 9650029242287828579) % 18446744073709551616 AS a FROM a1
), a3 AS (
  SELECT r, xor(a, a >> 33) * 14029467366897019727 % 18446744073709551616 AS a FROM a2
), a4 AS (
  SELECT r, xor(a, a >> 29) * 1609587929392839161 % 18446744073709551616 AS a FROM a3
), walk AS (
  SELECT r, m, xor(a, a >> 32) AS k, 0::BIGINT AS shard, 0::BIGINT AS ahead FROM a4, (VALUES (16), (17)) AS s(m)
  UNION ALL
  SELECT r, m, k2, ahead, floor((ahead + 1) * (2147483648::DOUBLE / ((k2 >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT r, m, ahead, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE ahead < m)
), place AS (
  SELECT r, max(CASE WHEN m = 16 THEN shard END)::INT AS shard, max(CASE WHEN m = 17 THEN shard END)::INT AS grown_shard FROM walk GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard
FROM c JOIN place ON c.r = place.r
"""
