"""Operator 2: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

The words of the test items are counted over all documents. An n-gram is rare, and a seed, if words that fell
independently would form it in fewer than one of CHANCE documents; so are the rarer half of each item's n-grams.
(Counts of whole n-grams would not do: a leak makes the very n-grams common that lead to it.) A document and an item
that share a seed are aligned word by word around it; copies, edited copies and paraphrases that keep most of an item's
words in order score above the threshold.

The items are a stated query set: they go to the tasks in blocks of bounded size, one pass over the documents each, so
no text is shuffled. Items of fewer than SEED words can't be told from chance and match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import ROW, stored, with_row_ids

#: Words of a seed.
SEED = 3
#: A seed forms by chance in at most one of so many documents.
CHANCE = 10_000
#: Least alignment score, as a share of the score that the whole item would have; chance alignments stay below 0.2.
THRESHOLD = 0.4
#: And at least the score of so many words in a row, or of the whole item if it is shorter.
LEAST_WORDS = 8
#: The score of so many words in a row is enough, however long the item is: parts of long items are leaks too.
ENOUGH_WORDS = 30
#: Alignment: a matching word, a replaced one, an inserted or left-out one.
MATCH, REPLACED, GAP = 2, -1, -1
#: Items of a block: with BLOCK_CHARS, what is sent to a task is at most about 400 MB, or what one longer item takes.
BLOCK_ITEMS = 20_000
#: Items of more words are aligned piece by piece; pieces overlap by half.
PIECE_WORDS = 4_000
#: Characters of a block: the usual limit, well below that bound.
BLOCK_CHARS = 16_000_000

WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Items:
    """One block of test items, prepared for lookup. `chosen` marks the seeds: all n-grams until `keep_rare` narrows them.

    `words` holds the pieces of the items (one for each but the long ones), `item` the place in `ids` of each piece.
    """

    ids: list
    item: list[int]
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    grams: np.ndarray
    owners: list[list[tuple[int, int]]]
    chosen: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[str, int] = {}
        item, words = [], []
        for k, (_, text) in enumerate(rows):
            own = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(text)], np.int64)
            for at in range(0, max(1, len(own) - PIECE_WORDS // 2), PIECE_WORDS // 2) if len(own) > PIECE_WORDS else [0]:
                item.append(k)
                words.append(own[at : at + PIECE_WORDS])
        places: dict[int, list[tuple[int, int]]] = {}
        for k, own in enumerate(words):
            for at, g in enumerate(keys(own, len(vocabulary)).tolist()):
                places.setdefault(g, []).append((k, at))
        grams = np.array(sorted(places), np.int64)
        return cls([r[0] for r in rows], item, vocabulary, words, grams, [places[g] for g in grams.tolist()], np.ones(len(grams), bool))

    def keep_rare(self, counts: dict[int, int], words: int, documents: int) -> None:
        """Mark the seeds, given how often each word occurs among all `words` of the documents."""
        share = np.array([counts.get(k, 0) for k in range(len(self.vocabulary))], np.float64) / max(1, words)
        self.chosen = np.zeros(len(self.grams), bool)
        place = {g: k for k, g in enumerate(self.grams.tolist())}
        for own in self.words:
            if len(own) >= SEED:
                at = np.array([place[g] for g in keys(own, len(self.vocabulary)).tolist()])
                expected = np.prod([share[own[k : len(own) - SEED + 1 + k]] for k in range(SEED)], axis=0) * words / max(1, documents)
                self.chosen[at[(expected < 1 / CHANCE) | (expected <= np.median(expected))]] = True

    def found(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers of the text, -1 for words of no item; places with a known n-gram; numbers of those n-grams)."""
        get = self.vocabulary.get
        own = np.array([get(w, -1) for w in tokens(text)], np.int64)
        places = np.flatnonzero(whole(own >= 0)) if len(own) >= SEED and len(self.grams) else np.zeros(0, np.int64)
        if not len(places):
            return own, places, places
        key = keys(own, len(self.vocabulary))[places]
        at = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        hit = self.grams[at] == key
        return own, places[hit], at[hit]


def whole(known: np.ndarray) -> np.ndarray:
    """Where an n-gram starts whose words are all known."""
    out = known[: len(known) - SEED + 1].copy()
    for k in range(1, SEED):
        out &= known[k : len(known) - SEED + 1 + k]
    return out


def keys(own: np.ndarray, base: int) -> np.ndarray:
    """One number for each n-gram. Blocks are small enough for base ** SEED to fit 64 bits."""
    if len(own) < SEED:
        return np.zeros(0, np.int64)
    key = np.zeros(len(own) - SEED + 1, np.int64)
    for k in range(SEED):
        key = key * base + own[k : len(own) - SEED + 1 + k]
    return key


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place in `passage` where it ends (exclusive); rows are vectorised."""
    ramp = -GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        np.maximum(step[1:], row[:-1] + np.where(passage == word, MATCH, REPLACED), out=step[1:])
        row = np.maximum.accumulate(step + ramp) - ramp
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def least_score(words: int, threshold: float) -> float:
    """Score from which an alignment with an item (or piece) of so many words counts."""
    return MATCH * min(max(threshold * words, min(words, LEAST_WORDS)), max(ENOUGH_WORDS, LEAST_WORDS))


def matches(text: str | None, items: Items, threshold: float) -> list[tuple[object, float, int, int]]:
    """(item id, score, first and end word) of the best alignment with each item that reaches the threshold.

    The score is the share of the item's full score, and for a long item that of its best piece.
    """
    own, places, grams = items.found(text)
    windows: dict[int, list[tuple[int, int]]] = {}
    for at, g in zip(places.tolist(), grams.tolist()):
        if items.chosen[g]:
            for k, offset in items.owners[g]:
                # Each word that an alignment inserts costs GAP: one that reaches the threshold can't stray further.
                m = len(items.words[k])
                far = int((MATCH * m - least_score(m, threshold)) / -GAP) + 1
                windows.setdefault(k, []).append((max(0, at - offset - far), min(len(own), at - offset + m + far)))
    out: dict[int, tuple] = {}
    for k, spans in windows.items():
        item, best = items.words[k], (0, 0, 0)
        least = least_score(len(item), threshold)
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        kinds, need = np.unique(item, return_counts=True)
        for a, b in merged:
            passage = own[a:b]
            have = np.bincount(np.searchsorted(kinds, passage[np.isin(passage, kinds)]), minlength=len(kinds))
            if MATCH * np.minimum(have, need).sum() < least:  # no alignment can score more than its shared words
                continue
            score, end = align(item, passage)
            if score > best[0]:
                best = (score, a, a + end)
        if best[0] >= least and (items.item[k] not in out or best[0] > out[items.item[k]][0]):
            _, back = align(item[::-1], own[best[1] : best[2]][::-1])
            out[items.item[k]] = (best[0], items.ids[items.item[k]], best[0] / (MATCH * len(item)), best[2] - back, best[2])
    return [found[1:] for found in out.values()]


def char_spans(text: str, found: list[tuple[object, float, int, int]]) -> list[dict]:
    """The words that align, and the code points of the text as it stands that they are."""
    low = text.lower()
    at = [m.span() for m in WORD.finditer(low)]
    if len(low) != len(text):  # a few letters become several in lower case
        ends = np.cumsum([len(c.lower()) for c in text])
        at = [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1) for a, b in at]
    return [{"item_id": i, "score": s, "word_start": a, "word_end": b, "char_start": at[a][0], "char_end": at[b - 1][1]} for i, s, a, b in found]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (item_id, text) with at most BLOCK_ITEMS items and about BLOCK_CHARS characters; a longer item is a block of its own."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = row["text"] or ""
        if block and (len(block) == BLOCK_ITEMS or size + len(text) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def prepared(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """Each block of items, with the seeds that the counts over all documents leave."""
    for rows in blocks(benchmark):
        items = Items.of(rows)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            get, size = sent.value.vocabulary.get, len(sent.value.vocabulary)
            total = np.zeros(size + 2, np.int64)  # then all words, and all documents
            for batch in batches:
                for text in batch["text"]:
                    found = tokens(text)
                    total[:size] += np.bincount([k for w in found if (k := get(w)) is not None], minlength=size)[:size]
                    total[size:] += len(found), 1
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"word": np.where(seen < size, seen, seen - size - 2), "n": total[seen]})

        counted = docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        number = {r["word"]: r["n"] for r in counted.collect()}  # at most as many as the block has words
        items.keep_rare(number, number.get(-2, 0), number.get(-1, 0))
        sent.unpersist()
        yield items


def match_column(sent: Broadcast, id_type: str, threshold: float) -> Column:
    @F.pandas_udf(f"array<struct<item_id:{id_type},score:double,word_start:int,word_end:int,char_start:int,char_end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([char_spans(t, found) if (found := matches(t, sent.value, threshold)) else [] for t in texts], dtype=object)

    return find("text")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, key: str) -> DataFrame | None:
    """(key, item_id, score, words, code points) of all leaks, stored; None without items.

    One block of items is in memory at a time, in the driver and in tasks, however many there are.
    """
    spark, id_type, out = docs.sparkSession, dict(benchmark.dtypes)["item_id"], None
    for items in prepared(docs, benchmark):
        sent = spark.sparkContext.broadcast(items)  # at most BLOCK_ITEMS items
        found = stored(docs.select(key, F.explode(match_column(sent, id_type, threshold)).alias("m")).select(key, "m.*"))
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """One row per document and test item that it holds: score and the words and code points that align best.

    Null and empty texts and items match nothing; repeated rows of either side are matched each; null keys are kept
    as they are. Of a document's equally good alignments with an item the first counts; other columns aren't read.
    Without items the result is empty.
    """
    out = leaks(docs, benchmark, threshold, key)
    if out is None:
        spans = ", ".join(f"cast(null as {t}) as {c}" for c, t in (("item_id", dict(benchmark.dtypes)["item_id"]), ("score", "double"), ("word_start", "int"), ("word_end", "int"), ("char_start", "int"), ("char_end", "int")))
        return docs.select(key, *[F.expr(x) for x in spans.split(", ")]).filter("false")
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, from_files: bool | None = None) -> DataFrame:
    """The documents that hold no test item, unchanged, with all their columns.

    Null and empty texts hold none and stay, repeated rows are judged each, and without items or documents nothing goes.
    Rows are told apart by their place in the files that `docs` is read from or is stored in first.
    """
    numbered = with_row_ids(docs, from_files=from_files)
    found = leaks(numbered, benchmark, threshold, ROW)
    if found is None:
        return docs
    gone = stored(found.select(F.col(ROW).alias("_gone")).distinct())
    return numbered.join(gone, F.col(ROW) == F.col("_gone"), "left_anti").select(*docs.columns)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; odd rows and tables are as in without_contaminated."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
