"""Packing: ids against the tokenizers library, placement against the contract, balance against filling in order."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from sheetwise.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_library(library):
    encode, rng = packing.encoder(VOCABULARY), random.Random(11)
    for c in range(0, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}.{chr(c)}'s  x"
            assert encode(t) == library(t), hex(c)
    letters = "aZ19 .\n\t　 é中😀'<|>#_-"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert encode(t) == library(t)
    for t in ("a<|endoftext|>b", " " * 300_000, "\n" * 300_000 + "x", "a" * 300_000, "word " * 60_000 + " " * 5000 + "end"):
        assert encode(t) == library(t)


def check(pieces, lengths, capacity):
    upto, used = collections.Counter(), collections.Counter()
    for item, start, n, _, _ in pieces:
        assert n > 0 and start == upto[item]
        upto[item] += n
    for _, _, n, sequence, offset in sorted(pieces, key=lambda p: p[3:]):
        assert offset == used[sequence]
        used[sequence] += n
    assert [upto[k] for k in range(len(lengths))] == list(lengths) and max(used.values(), default=0) <= capacity
    assert len(used) == -(-sum(lengths) // capacity)
    return used


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 1024])
def test_placement(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(60):
        lengths = rng.integers(1, 4 * capacity + 2, rng.integers(0, 80))
        check(packing.assign(lengths, capacity), lengths, capacity)


def plainly(lengths, capacity):
    """The method without heaps: every step looks at all sequences."""
    spent, room = [0.0] * -(-sum(lengths) // capacity), [capacity] * -(-sum(lengths) // capacity)
    waiting, out = [(n, k, 0) for k, n in enumerate(lengths)], []
    while waiting:
        longest = max(w[0] for w in waiting)
        n, item, start = waiting.pop(next(i for i, w in enumerate(waiting) if w[0] == longest))
        able = [s for s in range(len(room)) if room[s] >= min(n, capacity)] or [s for s in range(len(room)) if room[s]]
        s = min(able, key=lambda s: (spent[s], room[s], s))
        taken = min(n, room[s])
        out.append((item, start, taken, s, capacity - room[s]))
        spent[s] += packing.cost(taken)
        room[s] -= taken
        if n > taken:
            waiting.append((n - taken, item, start + taken))
    return sorted(out)


def test_against_the_plain_method():
    rng = np.random.default_rng(2)
    for _ in range(80):
        lengths = rng.integers(1, 90, rng.integers(0, 30)).tolist()
        assert packing.assign(np.array(lengths, np.int64), 32) == plainly(lengths, 32)


def test_costs_are_balanced():
    """Against first fit of descending lengths, which fills sequences with their like."""
    lengths = np.minimum(np.random.default_rng(1).lognormal(5, 1, 4000).astype(int) + 1, 600)

    def spread(pieces):
        spent = collections.Counter()
        for _, _, n, sequence, _ in pieces:
            spent[sequence] += packing.cost(n, 8)
        return np.std(list(spent.values()))

    first_fit, room = [], []
    for n in sorted(lengths.tolist(), reverse=True):
        s = next((s for s, r in enumerate(room) if r >= n), len(room))
        room[s:] = [1024 - n] if s == len(room) else [room[s] - n, *room[s + 1 :]]
        first_fit.append((0, 0, n, s, 0))
    assert spread(packing.assign(lengths, 1024, 8)) < 0.5 * spread(first_fit)


def test_whole_table(spark, library):
    """Every id in one piece, with its checksum; padding under one sequence a block; the same when run again."""
    from sheetwise.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op11_cost_balanced_packing"](spark, "/root/testdata/sf0.001").collect()
    ids = {k: [*library(t or ""), 0] for k, t in texts.items()}
    upto, used = collections.Counter(), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == upto[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        upto[r["doc_id"]] += r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert upto == {k: len(v) for k, v in ids.items()}
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    tokens = sum(map(len, ids.values()))
    assert len(used) * 1024 - tokens < 4 * 1024
    again = QUERIES["op11_cost_balanced_packing"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(again) == sorted(got)


def test_assembled(spark, library):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "four " * 900)], "doc_id long, text string")
    got = packing.assembled(packing.packed(docs, VOCABULARY, 64), 64).collect()
    total = sum(len(library(t)) + 1 for t in ("one two three", "", "four " * 900))
    assert sum(sum(r["lengths"]) for r in got) == total
    for r in got:
        n = sum(r["lengths"])
        assert len(r["tokens"]) == (n if n & (n - 1) == 0 else 64)
