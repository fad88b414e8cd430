"""Operators over ordered rows: carried state, interval merging, clustering, report order, reading order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """The last non-null value so far, row by row."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, tolerance: float = 3.0) -> DataFrame:
    """Intervals of each group joined where the next begins within `tolerance` of the furthest end so far."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (reach.isNull() | (F.col(start) > reach + tolerance)).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).withColumnRenamed("_run", "run")


def anchor_clusters(values: Column, tolerance: float) -> Column:
    """Clusters of a sorted array of numbers; each holds what lies within `tolerance` of its first member (not of its last)."""
    start = F.array().cast("array<struct<first:double,n:bigint,total:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"), (last["total"] + x).alias("total"))
        fresh = F.struct(x.alias("first"), F.lit(1).cast("bigint").alias("n"), x.alias("total"))
        joins = last.isNotNull() & (x - last["first"] <= tolerance)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(F.sort_array(values), start, step)


def report_order(pairs: DataFrame, by: Sequence[str], new: str, old: str) -> DataFrame:
    """Place of each section in a report: new order; unmatched old sections follow the nearest earlier paired one.

    `pairs` has a row per new section (with its old one or null) and per unmatched old section (new is null).
    """
    anchored = carry_forward(pairs.filter(F.col(old).isNotNull()), F.col(new), by, [old], "_anchor")
    only_new = pairs.filter(F.col(old).isNull()).withColumn("_anchor", F.col(new))
    both = anchored.unionByName(only_new).withColumn("_anchor", F.when(F.col(new).isNotNull(), F.col(new)).otherwise(F.coalesce("_anchor", F.lit(-1))))
    w = Window.partitionBy(*by).orderBy("_anchor", F.col(new).isNull(), old)
    return both.withColumn("position", F.row_number().over(w)).drop("_anchor")


def weighted_mode(df: DataFrame, by: Sequence[str], value: str, weight: Column, order: Column) -> DataFrame:
    """Per group the value with the most weight; of ties, the one that appears first."""
    total = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"), F.min(order).alias("_o"))
    return total.groupBy(*by).agg(F.max_by(value, F.struct(F.col("_w"), -F.col("_o"))).alias(value))


def reading_order(df: DataFrame, by: Sequence[str], x: str, y: str, middle: Column) -> DataFrame:
    """Two-column pages read left column first: if three or more pieces start right of the middle."""
    right = F.col(x) >= middle - 5
    columns = F.count_if(right).over(Window.partitionBy(*by)) >= 3
    w = Window.partitionBy(*by).orderBy(F.when(columns & right, 1).otherwise(0), y, x)
    return df.withColumn("reading", F.row_number().over(w))


def page(df: DataFrame, order: Sequence[str], number: int, size: int = 60) -> DataFrame:
    """One page of a listing."""
    return df.orderBy(*order).offset(number * size).limit(size)


def facets(df: DataFrame, search: str = "", **equal: str) -> DataFrame:
    """Rows whose columns equal the given values and whose joined text holds `search`, whatever its case."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    if search:
        df = df.filter(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])).contains(search.lower()))
    return df
