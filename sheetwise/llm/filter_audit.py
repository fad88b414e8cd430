"""Operator 12: which filters remove which documents, alone, together and in every order.

Each document gets a mask of the filters that it fails. All figures of an order are sums over masks, so the corpus is
read once, counted by part and mask, and the 120 orders are worked out from those counters.

Whether a text was seen before is found by sorting: rows are dealt by ranges of (fingerprint, doc_id), sorted by
(fingerprint, text, doc_id), and compared with their predecessors. A text's rows follow each other; its first row has
the least id, and later rows with greater ids fail. Where a range begins amid a text's rows, the earlier ranges' last
rows tell the text's first id: one small row a range. So a text of which a third of all rows are copies is spread over
as many ranges as it fills.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import stored, words

#: The filter that fails texts of earlier documents; its condition is the sort.
SEEN = "E"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that judge a text alone (fixed by the result contract)."""
    w = words(text)
    return {
        "A": F.size(w) < 100,
        "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def seen_before(rows: DataFrame, bit: int) -> DataFrame:
    """(doc_id, part, mask) of rows (doc_id, part, text, mask): `bit` is added to masks of texts that a smaller doc_id has.

    Texts are compared whole within a range, and by their SHA-256 across ranges. Null ids are neither smaller nor
    greater than others. Repeated rows are judged alike.
    """
    key = dict(rows.dtypes)["doc_id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their verdict; those of the first text also with its fingerprint. At the end the last text's first id."""
        text, first, runs, fp = None, None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            prints, texts, ids, part, mask = batch.columns
            same = np.concatenate([[text is not None and texts[0].as_py() == text], pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)]).astype(bool)
            start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))  # each row's first row of its text
            firsts = ids.take(pa.array(start))
            held = int(np.argmin(same)) if not same.all() else n  # rows that go on from the batch before
            if held:
                firsts = pa.concat_arrays([pa.array([first] * held, ids.type), firsts.slice(held)])
            later = pc.fill_null(pc.greater(ids, firsts), False).to_numpy(zero_copy_only=False)
            run = runs + np.cumsum(~same)
            opening = pc.if_else(pa.array(run == 1), prints, pa.scalar(None, prints.type))
            masks = mask.to_numpy() + np.where(later, bit, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, part, pa.array(masks, pa.int32()), opening, pa.nulls(n, prints.type)], names=["doc_id", "part", "mask", "opening", "closing"])
            text, first, runs, fp = texts[n - 1].as_py(), firsts[n - 1].as_py(), int(run[-1]), prints[n - 1].as_py()
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array([first], ids.type), pa.nulls(1, part.type), pa.nulls(1, pa.int32()), pa.nulls(1, prints.type), pa.array([fp], prints.type)], names=["doc_id", "part", "mask", "opening", "closing"])

    # Sampling for the ranges sees fingerprints and ids only; the salt spreads repeated rows.
    keyed = rows.withColumn("fp", F.unhex(F.sha2("text", 256))).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = keyed.repartitionByRange(F.col("fp"), F.col("doc_id").asc_nulls_last(), F.col("salt"))
    ordered = ranged.sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last()).select("fp", "text", "doc_id", "part", "mask")
    judged = stored(ordered.mapInArrow(compare, f"doc_id {key}, part string, mask int, opening binary, closing binary"))
    # One row a range at most.
    before = judged.filter("closing IS NOT NULL").groupBy(F.col("closing").alias("fp")).agg(F.min("doc_id").alias("first"))
    joined = judged.filter("closing IS NULL").join(F.broadcast(before), F.col("opening") == F.col("fp"), "left")
    return joined.select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask")).alias("mask"))


def part_counters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good and toxic, of each part and mask. Additive.

    Filters have the bits 1, 2, 4, ... in their order, SEEN the next one. A document of several labels is good if any says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = seen_before(docs.select("doc_id", F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), text.alias("text"), mask.cast("int").alias("mask")), 1 << len(filters))
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"))
    # Rows meet labels once they are counted by id, so an id that many rows share is one row here.
    failing = rows.filter("mask <> 0 AND doc_id IS NOT NULL").groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    lost = failing.join(known.filter("id IS NOT NULL AND good + toxic > 0"), F.col("doc_id") == F.col("id"))
    lost = lost.groupBy(F.col("part").alias("p"), F.col("mask").alias("m")).agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    joined = counted.join(lost, (F.col("part") == F.col("p")) & (F.col("mask") == F.col("m")), "left")
    return joined.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def roles(spark: SparkSession, letters: str) -> DataFrame:
    """What a mask means at each step of each order: 32 masks by 600 steps for five filters, whatever the corpus."""
    bit, rows = {c: 1 << k for k, c in enumerate(letters)}, []
    for order in permutations(letters):
        earlier = 0
        for step, c in enumerate(order, 1):
            for mask in range(1 << len(letters)):
                fails, gone = bool(mask & bit[c]), bool(mask & earlier)
                rows.append((mask, "".join(order), step, c, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == bit[c])))
            earlier |= bit[c]
    names = ("m", "filter_order", "step", "letter", "keeps", "removes", "repeats", "alone")
    types = (pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names)))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, part: str = "lang") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `filters` names the conditions under which a text fails, by one letter each, over a column `text` that is never
    null; SEEN joins them. Null parts are the part "", null texts are empty. Texts of any length are judged whole. Null
    ids have no labels. An empty table has no parts, so no rows. Other columns of the table aren't read.
    """
    filters = dict(filters or conditions(F.coalesce(F.col("text"), F.lit(""))))
    counters = stored(part_counters(docs, labels, filters, part))
    steps = counters.join(F.broadcast(roles(docs.sparkSession, "".join([*filters, SEEN]))), F.col("mask") == F.col("m"))
    total = lambda flag, what: F.sum(F.col(flag) * F.col(what))
    figures = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total("keeps", "n").alias("kept"), total("removes", "n").alias("removed"), total("repeats", "n").alias("redundant"), total("alone", "n").alias("unique_fails"),
        total("removes", "good").alias("good_lost"), total("removes", "toxic").alias("toxic_lost"))
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same in SQL.
ORACLE_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), m AS (
  SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w
), k AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN k ON m.doc_id = k.doc_id GROUP BY part, fails
), f AS (SELECT unnest(range(1, 6)) AS i), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, f.i::INT AS step, o[f.i] AS letter,
    fails[o[f.i]] AS here, len(list_filter(o[:f.i - 1], lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS single, n, good, toxic FROM c, o, f
), g AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN here AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""
