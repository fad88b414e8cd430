"""Runs against a search of all periods, and the query against a plain reading of its contract."""

import hashlib
import random
import zlib

import numpy as np

from sheetwise.llm import periodic


def plain_runs(w):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(12, 2 * p) and not any(w[s : e - q] == w[s + q : e] for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out)


def test_all_periods():
    rng = random.Random(3)
    for _ in range(3000):
        kinds, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.randint(0, 90)
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, p, e = rng.randrange(n), rng.randint(1, 20), rng.randint(0, n)
            for i in range(a + p, e):
                w[i] = w[i - p]
        assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w), w


def test_nested_and_rich_words():
    fib, last = [0, 1], [0]
    while len(fib) < 400:
        fib, last = fib + last, fib
    nested = (([1, 2, 3] * 5 + [4]) * 4 + [5, 6]) * 3
    for w in (fib, nested, [7] * 500, [1, 2] * 200 + [1], [1, 1, 2, 1, 3] * 60, [1] * 40 + [2] * 40 + [1] * 40):
        assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_probes_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PROBES", 7)
    monkeypatch.setattr(periodic, "CHUNK", 1)
    w = ([1, 2, 3, 4, 5] * 4 + [9]) * 5
    assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_long_text():
    w = np.concatenate([np.arange(40_000) + 10, np.tile([1, 2, 1, 3], 100_000), np.arange(300) + 9, np.arange(300) + 9])
    assert periodic.find_runs(w) == [(40_000, 400_000, 4), (440_000, 600, 300)]


def test_query(spark):
    from sheetwise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for k, text in texts.items():
        w = (text or "").encode().split()
        if len(w) > 1500:
            continue  # the plain search takes n squared steps
        h = zlib.crc32(str(k).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        runs, gone = plain_runs(w), set()
        for s, n, q in runs:
            gone |= set(range(s + q, s + n))
        r, best = got[k], max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
    assert planted > 5
