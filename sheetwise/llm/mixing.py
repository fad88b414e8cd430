"""Operator 10: mixing sources to target weights by Pfair scheduling (built-in functions only).

Each source's rows are cut into blocks. With target share p, block j of a source may start at its release time
floor(j / p) and must end by its deadline ceil((j + 1) / p). Earliest deadline first over these windows fills at most
one slot per unit of time, so at every time each source that still has rows has received its share to within less than
one block. The shares are the exact quotients of the given weights, never rounded, so this holds for any number of
sources and at any length. Scheduling is sequential: the driver makes it from the row counts alone, one entry per
block, and writes it out in pieces of bounded size; every block then finds its slot by an equality join.

When a source runs out, its slots stay empty and the others keep their windows: no row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import ROW, globally_ranked, scratch_dir, stored, with_row_ids

SLOT, PLACE = "__sheetwise_slot__", "__sheetwise_place__"
#: Rows of a block.
BLOCK_ROWS = 16
#: Entries of the schedule that the driver holds at once.
PIECE = 200_000


def schedule(weights: Mapping[str | None, float], blocks: Mapping[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks of each source, by earliest deadline first.

    Ties go to the source that comes first in `weights`. All sources of `weights` share the time, whether they have
    blocks or not. Times are exact: weights are taken as the fractions that they are. Memory grows with the number of
    sources only.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("every source needs a weight above 0")
    exact = [Fraction(w) for w in weights.values()]
    scale = lcm(*[w.denominator for w in exact]) if exact else 1
    whole, names = [int(w * scale) for w in exact], list(weights)
    total, last = sum(whole), [blocks.get(s, 0) for s in names]
    # A source's next block waits until its release, then until no rival has an earlier deadline.
    waiting = [(0, k, 0) for k in range(len(names)) if last[k]]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // whole[k]), k, j, release))
        deadline, k, j, release = heapq.heappop(ready)
        yield names[k], j, release, deadline, slot
        slot += 1
        if j + 1 < last[k]:
            heapq.heappush(waiting, ((j + 1) * total // whole[k], k, j + 1))


def schedule_table(spark: SparkSession, weights: Mapping[str | None, float], blocks: Mapping[str | None, int]) -> DataFrame:
    """The schedule as a stored table; the driver holds PIECE entries at once."""
    path, entries = scratch_dir(spark), schedule(weights, blocks)
    schema = pa.schema([("_source", pa.string()), *[(c, pa.int64()) for c in ("_j", "_release", "_deadline", "_slot")]])
    columns: list = [()] * len(schema)
    while True:
        piece = list(itertools.islice(entries, PIECE))
        if piece:
            columns = list(zip(*piece))
        table = pa.table([pa.array(c if piece else [], f.type) for c, f in zip(columns, schema)], schema)
        spark.createDataFrame(table).write.mode("append").parquet(path)
        if len(piece) < PIECE:
            return spark.read.schema("_source string, _j long, _release long, _deadline long, _slot long").parquet(path)


def tempered(counts: Mapping[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Default target weights: row counts to a power below 1, so that small sources are heard more often."""
    return {s: float(n) ** power for s, n in counts.items() if n}


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", order: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add source_row, block, release, deadline and slot to all rows; ordering by slot, then source_row, mixes them.

    `weights` maps every source that occurs (None: null sources) to its target; without it, the square roots of the
    row counts are the targets. Rows of a source are taken in the order of `order` (nulls first; ties in any, fixed,
    order). An empty table gives an empty result with the same columns. Existing columns of the five names are replaced.
    """
    kept = [c for c in df.columns if c not in ("source_row", "block", "release", "deadline", "slot")]
    # The rows' own columns get plain numbers for names meanwhile, so that none can clash.
    df = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    source, order = f"c{kept.index(source)}", f"c{kept.index(order)}"
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}
    targets = dict(weights) if weights else tempered(counts)
    if missing := [s for s in counts if s not in targets]:
        raise ValueError(f"no weight for {missing[:3]}")
    targets = {s: targets[s] for s in sorted(targets, key=lambda s: (s is not None, s or ""))}
    table = schedule_table(df.sparkSession, targets, {s: -(-n // block_rows) for s, n in counts.items()})
    ranked = globally_ranked(df, source, [F.col(order).asc_nulls_first()], "source_row").withColumn("block", F.floor(F.col("source_row") / block_rows))
    # No key is large: a block has at most block_rows rows, and one entry in the schedule.
    placed = ranked.join(table, F.col(source).eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_j")))
    return placed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], "source_row", "block", F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, laid out in the mixed order (partition after partition, sorted by slot).

    The schedule is made from narrow rows; texts move once to their schedule rows and once into order, to the partition
    that their slot names. Rows are told apart by their place in the files that `docs` is read from, or is stored in
    first; one that the schedule doesn't know fails the job. Texts of any length are moved whole. Null sources are a source of
    their own; an empty table stays empty; the columns are those of `docs`, whatever their names.
    """
    numbered = with_row_ids(docs)
    plan = stored(mix(numbered.select(ROW, "doc_id", "source")).select(F.col(ROW).alias("_planned"), F.col("slot").alias(SLOT), F.col("source_row").alias(PLACE)))
    slots, parts = (plan.agg(F.max(SLOT)).first()[0] or 0) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    unknown = F.raise_error(F.lit("a row of the table isn't in the schedule"))
    mixed = numbered.join(plan, F.col(ROW) == F.col("_planned"), "left").withColumn(SLOT, F.when(F.col(SLOT).isNull(), unknown.cast("long")).otherwise(F.col(SLOT)))
    # A slot holds one block, so equal stretches of slots are even partitions however large a source is.
    return mixed.repartitionById(parts, F.floor(F.col(SLOT) * parts / slots).cast("int")).sortWithinPartitions(SLOT, PLACE).select(*docs.columns)


#: The same in SQL: the earliest deadline among released blocks, step by step.
ORACLE_OP10 = f"""
WITH RECURSIVE n AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), src AS (
  SELECT list(sqrt(n::DOUBLE) ORDER BY source NULLS FIRST) AS w, list((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} ORDER BY source NULLS FIRST) AS b,
    list(source ORDER BY source NULLS FIRST) AS names, sum(sqrt(n::DOUBLE)) AS total FROM n
), run AS (
  SELECT 0::BIGINT AS next, list_transform(b, lambda x: 0::BIGINT) AS c, NULL::BIGINT AS k, NULL::BIGINT AS j, NULL::BIGINT AS release, NULL::BIGINT AS deadline, NULL::BIGINT AS slot FROM src
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, i: CASE WHEN i = best.k THEN x + 1 ELSE x END), best.k, c[best.k], floor(c[best.k] * total / w[best.k])::BIGINT, best.d, t FROM (
    SELECT c, total, w, t, list_sort(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i] < b[i] AND floor(c[i] * total / w[i]) <= t),
      lambda i: {{'d': ceil((c[i] + 1) * total / w[i])::BIGINT, 'k': i}}))[1] AS best
    FROM (SELECT c, total, w, b, greatest(next, list_min(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i] < b[i]), lambda i: floor(c[i] * total / w[i])::BIGINT))) AS t FROM run, src)
  ) WHERE best IS NOT NULL
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS source_row FROM documents
)
SELECT doc_id, r.source, source_row, source_row // {BLOCK_ROWS} AS block, release, deadline, slot
FROM r JOIN (SELECT names[k] AS source, j, release, deadline, slot FROM run, src WHERE k IS NOT NULL) s ON r.source IS NOT DISTINCT FROM s.source AND source_row // {BLOCK_ROWS} = s.j
"""
