"""The audit against applying the filters one after the other, with texts cut by many ranges."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from sheetwise.llm import filter_audit

GOOD = " ".join(f"word{k}" for k in range(120))
ROWS = [(1, GOOD, "en"), (2, "short", "en"), (3, "short", "de"), (3, "short", "de"), (4, "a # b " * 60, "en"), (5, None, None), (6, "", None), (7, GOOD, None), (None, GOOD, "en"), (8, "SHOUT " * 120, "en"),
        (9, "a # b " * 60, "de"), (2, "short", "en"), (10, GOOD + "!", "")] + [(100 + k, "copied passage", "en") for k in range(300)] + [(50, "copied passage", "fr")] * 40
LABELS = [(2, 1, 1), (4, 1, 0), (9, None, 1), (9, 1, None), (8, 0, 1), (None, 1, 1), (100, 1, 1), (150, 1, 1)]


def plain_audit(rows, labels):
    text, words = (lambda r: r[1] or ""), (lambda r: re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    first = {}
    for r in rows:
        if r[0] is not None:
            first[text(r)] = min(r[0], first.get(text(r), r[0]))
    fails = {
        "A": lambda r: len(words(r)) < 100, "B": lambda r: 100 * len(set(words(r))) < 80 * len(words(r)),
        "C": lambda r: 100 * len(re.findall("[A-Z]", text(r))) > 10 * len(text(r)), "D": lambda r: bool(re.search(r"[#$%&*|]", text(r))),
        "E": lambda r: r[0] is not None and r[0] > first[text(r)]}
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    bad = [{c for c in fails if fails[c](r)} for r in rows]
    out, by_filter = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[2] or "" for r in rows}:
            left = [(r, b) for r, b in zip(rows, bad) if (r[2] or "") == part]
            everyone = left
            for step, c in enumerate(order, 1):
                gone = [(r, b) for r, b in left if c in b]
                left = [(r, b) for r, b in left if c not in b]
                all_fail = sum(c in b for _, b in everyone)
                out[part, order, step] = [len(left), len(gone), all_fail - len(gone), sum(b == {c} for _, b in everyone), sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone)]
                by_filter[part, c] += len(gone)
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_filters_one_after_the_other(spark, ranges):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3, F.xxhash64("doc_id"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = filter_audit.audit(docs, labels).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows} == plain_audit(ROWS, LABELS)


def test_batches_within_a_text(spark):
    """A text's rows go on from one Arrow batch to the next."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(k, "p", "x" if k % 5 else "y", 0) for k in range(20, 0, -1)] + [(None, "p", "y", 0), (0, "p", "z", 2)], "doc_id long, part string, text string, mask int")
        got = sorted((r["doc_id"], r["mask"]) for r in filter_audit.seen_before(rows, 16).filter("doc_id IS NOT NULL").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(0, 2)] + [(k, 0 if k in (1, 5) else 16) for k in range(1, 21)]
