"""Operator 13: periodic runs of words, found by probing a harmonic grid.

A run is a stretch of words with smallest period p that is at least max(LEAST, 2p) long and cannot be extended. Any
stretch of length 2p contains two neighbouring points jp and (j+1)p of the grid of p, and their words are equal. So for
every period only the grid is probed, n/1 + n/2 + n/3 + ... = O(n log n) words in all; a pair that survives is extended
to both sides by comparing arrays chunk by chunk.

Pairs inside found runs are skipped: one that lies in a run whose period q divides p can only lead to that run again, and
one that lies at least q inside a run of any smaller period q cannot start a run (two periods p and q share p + q - gcd
words in one stretch only if that stretch has their divisor as a period). Periods are taken upwards, so what survives
is a run of its smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewest words of a run; fixed by the result contract, as is the factor 2 of the period.
LEAST = 12
#: Words compared at first and at most at once when a pair is extended; grid pairs probed at once.
CHUNK, MOST_CHUNK, PROBES = 16, 1 << 16, 1 << 18


def matching(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays of the same length, compared in growing chunks."""
    at, step = 0, CHUNK
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + step, min(2 * step, MOST_CHUNK)
    return len(a)


class Found:
    """Runs found so far, by period: starts and ends in order."""

    def __init__(self) -> None:
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        self.starts.setdefault(period, []).append(start)
        self.ends.setdefault(period, []).append(end)

    def outside(self, left: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Which grid pairs (left, left + period) may still start a run: True where no found run speaks for them."""
        open_ = np.ones(len(left), bool)
        for q, starts in self.starts.items():
            start, end = np.array(starts), np.array(self.ends[q])
            k = np.searchsorted(start, left, "right") - 1
            margin = np.where(period % q == 0, 0, q)
            for back in (0, 1):  # two runs of one period may overlap, by less than it
                at = np.maximum(k - back, 0)
                open_ &= ~((k >= back) & (start[at] + margin <= left) & (left + period + margin < end[at]))
        return open_

    def rows(self) -> list[tuple[int, int, int]]:
        return sorted((s, e - s, q) for q in self.starts for s, e in zip(self.starts[q], self.ends[q]))


def probes(n: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, period) of all grid pairs of the periods low to high - 1 in n words, some at a time, periods upwards."""
    while low < high:
        periods = np.arange(low, high)
        counts = (n - 1) // periods
        upto = max(1, int(np.searchsorted(np.cumsum(counts), PROBES, "right")))
        periods, counts, low = periods[:upto], counts[:upto], low + upto
        period = np.repeat(periods, counts)
        j = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield j * period, period


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array, by start, then period."""
    n, found = len(codes), Found()
    low = 1
    while low <= n // 2 and n >= LEAST:
        high = min(2 * low, n // 2 + 1)  # no period of a round divides another one of it
        for left, period in probes(n, low, high):
            equal = codes[left] == codes[left + period]
            left, period = left[equal], period[equal]
            # A run has LEAST / 2 equal pairs in a row at least, so a lone one is chance.
            beside = (codes[left - 1] == codes[left + period - 1]) & (left > 0)
            after = np.minimum(left + period + 1, n - 1)
            beside |= (codes[after - period] == codes[after]) & (left + period + 1 < n)
            left, period = left[beside], period[beside]
            open_ = found.outside(left, period)
            done = {}  # end of the stretch that was extended last, by period
            for at, p in zip(left[open_].tolist(), period[open_].tolist()):
                if at + p < done.get(p, 0):
                    continue
                end = at + p + matching(codes[at : n - p], codes[at + p :])
                start = at - matching(codes[:at][::-1], codes[p : at + p][::-1])
                done[p] = end
                if end - start >= max(LEAST, 2 * p):
                    found.add(start, end, p)
        low = high
    return found.rows()


def collapsed(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period, joined by one space."""
    if not runs:
        return b" ".join(parts)
    depth = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([w for w, gone in zip(parts, np.cumsum(depth).tolist()) if not gone])


def periodic_runs(text: Column) -> Column:
    """Struct (runs: array of start, length, period in words; collapsed: the text with each run's first period only).

    Words are maximal strings without space and the ASCII controls 9 to 13; they are compared whole. Null, empty and
    blank texts have no runs and collapse to the empty text. Texts of any length are searched whole, in memory of a few
    numbers a word; each text is one task's own matter, so there is no shuffle and repeated rows cost nothing extra.
    """

    @F.pandas_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                parts, codes = (t or "").encode("utf-8", "surrogatepass").split(), {}
                runs = find_runs(np.array([codes.setdefault(w, len(codes)) for w in parts], np.int64)) if len(codes) < len(parts) or len(parts) >= LEAST else []
                out.append(([{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed(parts, runs).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["runs", "collapsed"])

    return search(text)


def planted(text: Column, doc_id: Column) -> Column:
    """The text with the contract's made-up repetition in every tenth document by the checksum of its id; null ids have none."""

    @F.pandas_udf("string")
    def repeat(texts: pd.Series, checksums: pd.Series) -> pd.Series:
        out = texts.tolist()
        for k, h in enumerate(checksums.tolist()):
            w = (out[k] or "").encode("utf-8", "surrogatepass").split() if h == h and h % 10 == 0 else []
            if w:
                g = int(h) // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                out[k] = b" ".join(w[i if i < a else a + (i - a) % p] for i in range(len(w))).decode("utf-8", "surrogatepass")
        return pd.Series(out, dtype=object)

    return repeat(text, F.crc32(F.encode(doc_id.cast("string"), "UTF-8")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", periodic_runs(planted(F.col("text"), F.col("doc_id"))).alias("r")).select("doc_id", "r.*")
    # The greatest by length; of ties the least start, then the least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
