"""Operator 11: packing documents into training sequences of balanced cost.

A step's time on a sequence grows with its tokens and, for attention inside each piece, with the square of the piece's
length. Documents are taken in descending cost; each goes to the sequence of least cost so far among those that have
room for it, and is cut only where none has: what fits goes to the least costly sequence with any room, the rest waits
its turn. There are as many sequences as the tokens fill, so padding is less than one sequence in each block.

Tokens are made in the scan and move once, as numbers of two bytes: rows are dealt by a hash of their place, so every
block of BLOCK_TOKENS tokens is a random sample of the corpus and blocks cost alike. A task packs its rows block by
block and holds one block at a time. Long documents are dealt in stretches of STRETCH tokens.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 1024, 0
#: Tokens of a stretch, of a block (memory of a task: a few numbers a token), and bytes of tokens handed on at once.
STRETCH, BLOCK_TOKENS, HAND_BYTES = 8 * CAPACITY, 1 << 22, 16 << 20
#: A model's width: a token's linear work is 12 times that many times its attention to one other token (causal).
WIDTH = 1024
#: White space beyond this length is left to the slower library, as the faster one recurses on it.
LONG_SPACE = re.compile(r"\s{2000}")


def cost(length: float, width: int = WIDTH) -> float:
    """Cost of a piece in units of one token's linear work."""
    return length + length * length / (12 * width)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the others from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [c for c in range(256) if c not in set(printable)]
    return {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(others)}


@functools.lru_cache(2)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Text -> ids of a byte-level BPE file of the tokenizers library; strings of special tokens are ordinary text.

    The same ranks run in tiktoken, three times as fast, with the same ids (test over all code points).
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    special, letters = {t["content"] for t in file["added_tokens"]}, byte_letters()
    ranks = {bytes(map(letters.__getitem__, w)): k for w, k in file["model"]["vocab"].items() if w not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = tokenizers.Tokenizer.from_file(vocabulary)
    slow.encode_special_tokens = True

    def encode(text: str) -> list[int]:
        if len(text) >= 2000 and LONG_SPACE.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def assign(lengths: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece, by item and start. No item is empty.

    Sequences of equal room wait in a heap by cost; `least` has the least cost of each room.
    """
    sequences = -(-int(lengths.sum()) // capacity)
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    by_room[capacity] = [(0.0, s) for s in range(sequences)]
    least = np.full(capacity + 1, np.inf)
    least[capacity] = 0.0 if sequences else np.inf
    # Cost rises with length, so descending cost is descending length; a rest comes back at its own length.
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(int(lengths.max(initial=0)) + 1)]
    for item, n in enumerate(lengths.tolist()):
        waiting[n].append((item, 0))
    pieces = []
    for n in range(len(waiting) - 1, 0, -1):
        for item, start in waiting[n]:
            want = min(n, capacity)
            room = want + int(least[want:].argmin())
            if least[room] == np.inf:
                room = 1 + int(least[1:want].argmin())
            spent, sequence = heapq.heappop(by_room[room])
            least[room] = by_room[room][0][0] if by_room[room] else np.inf
            taken = min(n, room)
            pieces.append((item, start, taken, sequence, capacity - room))
            if left := room - taken:
                heapq.heappush(by_room[left], (spent + cost(taken, width), sequence))
                least[left] = by_room[left][0][0]
            if n > taken:
                waiting[n - taken].append((item, start + taken))
    return sorted(pieces)


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit numbers).

    A document's ids are those of its text, then `end`; null and empty texts are that one id. Every row is packed, so
    repeated rows and null ids are kept; only doc_id and text are read. An empty table gives an empty result. Texts of
    any length are encoded whole, in their row's task, and packed in stretches. Sequence ids are unique, with gaps.
    """
    key = dict(docs.dtypes)["doc_id"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            at, start, total, ids, size = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "base", "doc_tokens", "ids"])  # noqa: B023

            for k, text in enumerate(batch.column(1)):
                own = np.array([*encode(text.as_py() or ""), end], "<u4")
                short = own.astype("<u2") if own.max() < 1 << 16 else own
                for a in range(0, len(own), STRETCH):
                    at.append(k)
                    start.append(a)
                    total.append(len(own))
                    ids.append(short[a : a + STRETCH].tobytes())
                size += short.nbytes
                if size > HAND_BYTES:
                    yield made()
                    at, start, total, ids, size = [], [], [], [], 0
            yield made()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            upto = 0
            for k, n in enumerate(batch.column(4).to_pylist()):
                if size and size + n > block_tokens:
                    yield pa.Table.from_batches([*held, batch.slice(upto, k - upto)])
                    held, size, upto = [], 0, k
                size += n
            held.append(batch.slice(upto))
        if size:
            yield pa.Table.from_batches(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        for block in blocks(batches):
            lengths = block.column("n").to_numpy()
            pieces = assign(lengths, capacity, width)
            tokens, out = block.column("ids"), []
            data, read = np.zeros(0, "<u4"), -1
            for item, start, n, _, _ in pieces:
                if item != read:
                    raw, read = tokens[item].as_py(), item
                    data = np.frombuffer(raw, "<u2" if len(raw) == 2 * lengths[item] else "<u4").astype("<u4")
                out.append(data[start : start + n].tobytes())
            item, start, n, own, offset = (np.array(c, np.int64) for c in zip(*pieces))
            base = block.column("base").to_numpy()
            table = pa.table({
                "doc_id": block.column("doc_id").take(item), "start": base[item] + start, "length": n, "doc_tokens": block.column("doc_tokens").take(item),
                "sequence_id": own + sequence, "offset": offset, "ids": pa.array(out, pa.binary())})
            yield from table.combine_chunks().to_batches()
            sequence += int(own.max()) + 1

    made = docs.select("doc_id", "text").mapInArrow(stretches, f"doc_id {key}, base long, doc_tokens long, ids binary")
    dealt = made.withColumn("n", F.least(F.lit(STRETCH), F.col("doc_tokens") - F.col("base"))).withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    # Sorted, so that a task that runs again packs alike.
    dealt = dealt.repartition("turn").sortWithinPartitions("turn").select("doc_id", "base", "doc_tokens", "ids", "n")
    return dealt.mapInArrow(pack, f"doc_id {key}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def assembled(pieces: DataFrame, capacity: int = CAPACITY, pad: int = END) -> DataFrame:
    """Per sequence: tokens (array, padded to `capacity` unless their number is a power of two) and the lengths of its pieces, for the attention mask."""

    @F.pandas_udf("array<int>")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            made = [np.frombuffer(b"".join(parts), "<u4").astype(np.int32) for parts in rows]
            yield pd.Series([t if len(t) & (len(t) - 1) == 0 else np.pad(t, (0, capacity - len(t)), constant_values=pad) for t in made])

    # A sequence has at most `capacity` tokens, so no group is large.
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return own.select("sequence_id", joined(F.col("p.ids")).alias("tokens"), F.col("p.length").alias("lengths"))


def op11_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
