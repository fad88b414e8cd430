"""Helpers that several corpus operators share: scratch tables, word splitting, global ranks, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls 9 to 13. Fixed by the result contracts.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: monotonically_increasing_id() keeps the partition above this bit and the row's place in it below.
ROW_BITS = 33
#: with_row_ids() keeps the file above this bit and the row's place in it below.
FILE_BITS = 40
#: Name of the row number that stages add next to a table's own columns, and drop again.
ROW = "__sheetwise_row__"
#: Texts that a Python worker gets at once.
BATCH_ROWS = 1000
#: A key is hot when it holds more than one in this many of all rows, so that there are at most so many hot keys.
HOT_SHARE = 2000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder that the cluster names; in local mode a temporary one where none is set.

    What is written there stays until that folder is cleared, as with Spark's own checkpoints: results read it lazily.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return f"{base.rstrip('/')}/sheetwise-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole texts go to Python at most `rows` at a time in this session: a worker holds two batches, and Spark one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def reads_files(df: DataFrame) -> bool:
    """Whether each row of `df` is a row of one table's files: nothing but columns chosen and rows left out since the scan."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def with_places(df: DataFrame, into: Sequence[str], from_files: bool | None = None) -> DataFrame:
    """Add three numbers that sort the rows as they were written: task and file (from the file's name), row in the file.

    Reading a table deals its files out by size, so the order of a stored table is in its files only. A table that isn't
    read from files as it stands is stored first, in the order of its partitions; `from_files` tells, or else its plan.
    """
    df = df if (reads_files(df) if from_files is None else from_files) else stored(df)
    number = lambda pattern: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(_metadata.file_name, '{pattern}', 1), '') as long)"), F.lit(0))
    places = [number("^part-([0-9]+)"), number("-c([0-9]+)[.]"), F.col("_metadata.row_index")]
    return df.select("*", *[p.cast("long").alias(c) for p, c in zip(places, into)])


def with_row_ids(df: DataFrame, into: str = ROW, from_files: bool | None = None) -> DataFrame:
    """Add a number of its own to each row: its file's place among all file names, and the row's place in that file.

    It is the same in every scan, however the files are dealt out and whichever executors are alive, so rows may be
    computed on in one reading and joined back in another. A table that isn't read from files as it stands is stored
    first; `from_files` tells, or else its plan. The rows' numbers differ between the two, what is made of them doesn't.
    """
    df = df if (reads_files(df) if from_files is None else from_files) else stored(df)
    path, at, name, number = (f"__sheetwise_{c}__" for c in ("path", "index", "name", "number"))
    # One row a file: the driver holds the list of files anyway. Nothing but file names is read here.
    names = df.select(F.col("_metadata.file_path").alias(name)).distinct()
    names = stored(names.select(name, (F.row_number().over(Window.orderBy(name)) - 1).cast("long").alias(number)))
    placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    joined = placed.join(F.broadcast(names), F.col(path) == F.col(name))
    return joined.withColumn(into, F.shiftleft(number, FILE_BITS) + F.col(at)).drop(path, at, name, number)


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def globally_ranked(df: DataFrame, group: str, order: Sequence[Column], rank: str) -> DataFrame:
    """Add `rank`: 0, 1, 2, ... within each `group`, by `order`, without one task ever holding a group.

    Rows are range-partitioned by group, order and a row number (so equal keys spread too) and sorted;
    a row's rank is its place in its partition plus the rows of its group in earlier partitions. Only one
    count per partition and group is moved besides the rows. The sorted rows are stored, so that both
    readings see the same places. Null groups form a group of their own.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    spread = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = (
        spread.repartitionByRange(*keys, F.col("_salt"))
        .sortWithinPartitions(*keys, F.col("_salt"))
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_salt")
    )
    rows = stored(placed).withColumn("_part", F.shiftright("_place", ROW_BITS))
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_at"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    joined = rows.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(rank, F.col("_place") + F.col("_shift")).drop("_place", "_part", "_group", "_at", "_shift")


def join_counted(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """Join `rows` with one row per key of `groups`, whose column `size` counts that key's rows out of `total`.

    Keys with more than 1/HOT_SHARE of all rows are at most HOT_SHARE many: those are broadcast, and their rows are
    spread over all partitions. All other keys meet in an ordinary shuffle join, where no key is large. Each join makes
    one row for each of `rows`, however many of them belong to a group; with `how` inner, the rest go after both.
    """
    limit = max(1, total // HOT_SHARE)
    fields = [c for c in groups.columns if c not in (key, size)]
    side = lambda name, test: groups.filter(test).select(F.col(key).alias(f"_{name}_key"), F.lit(True).alias(f"_{name}"), *[F.col(c).alias(f"_{name}_{c}") for c in fields])
    hot, cold = side("hot", F.col(size) > limit), side("cold", F.col(size) <= limit)
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # Rows that meet nothing in the second join, hot ones and null keys, are dealt by a number of their own.
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    spread = tagged.withColumn("_meet", F.when(alone, F.xxhash64(key, F.monotonically_increasing_id())).otherwise(F.xxhash64(key)))
    joined = spread.join(cold.withColumn("_met", F.xxhash64("_cold_key")), (F.col("_meet") == F.col("_met")) & (F.col(key) == F.col("_cold_key")), "left")
    if how == "inner":
        joined = joined.filter(F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in fields])
