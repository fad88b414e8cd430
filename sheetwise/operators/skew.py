"""Joining per-key figures back to rows when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are never more than HOT_KEYS hot keys to broadcast.
HOT_KEYS = 2000


def with_figures(rows: DataFrame, figures: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` with the columns of `figures`, which has one row per key of theirs (no null key) and counts its rows in `size`.

    Rows of hot keys stay where they are and look their figures up in a broadcast of at most HOT_KEYS rows; all other
    keys meet in a shuffle join, in which none is large.
    """
    total = figures.agg(F.sum(size))
    hot_from = F.coalesce(total.scalar(), F.lit(0)) / HOT_KEYS
    fields = [c for c in figures.columns if c != key]
    packed = figures.select(F.col(key).alias("_figures_key"), size, F.struct(*fields).alias("_figures"))
    hot, cold = packed.filter(F.col(size) > hot_from).drop(size), packed.filter(F.col(size) <= hot_from).drop(size)
    looked_up = rows.join(F.broadcast(hot.withColumnsRenamed({"_figures_key": "_hot_key", "_figures": "_hot"})), F.col(key) == F.col("_hot_key"), "left")
    # Rows that have their figures are dealt by a number of their own; they meet nothing.
    own = F.when(F.col("_hot").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    spread = looked_up.withColumn("_meet", own)
    met = spread.join(cold.withColumn("_cold_meet", F.xxhash64("_figures_key")), (F.col("_meet") == F.col("_cold_meet")) & (F.col(key) == F.col("_figures_key")), "left")
    both = F.coalesce("_hot", "_figures")
    return met.select(*rows.columns, *[both[c].alias(c) for c in fields])
