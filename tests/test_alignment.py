"""Order-keeping alignment against the whole table, by points and by rows, and at lengths that no table would hold."""

import random
import tracemalloc

import numpy as np
import pytest

from sheetwise.operators import alignment as al
from sheetwise.operators import narrative as nar


def whole_table(n, m, weight):
    """The plain way: the best sum from each pair of places on, then the path with its rule for ties."""
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], weight(i, j) + best[i + 1][j + 1] if weight(i, j) else 0)
    found, i, j = [], 0, 0
    while i < n and j < m and best[i][j]:
        if weight(i, j) and best[i][j] == weight(i, j) + best[i + 1][j + 1]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return found


@pytest.fixture(params=["points", "rows", "short rows"])
def way(request, monkeypatch):
    monkeypatch.setattr(al, "SPARSE", 10**9 if request.param == "points" else -1)
    if request.param == "short rows":
        monkeypatch.setattr(al, "CELLS", 8)
        monkeypatch.setattr(al, "FAN", 2)


def test_common_subsequences(way):
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdefgh"[: rng.choice([1, 2, 4, 8])]) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert [tuple(p) for p in al.matched(a, b).tolist()] == whole_table(len(a), len(b), lambda i, j: int(a[i] == b[j]))


def test_similar_word_sets(way):
    rng = random.Random(2)
    for _ in range(300):
        old, new = ([frozenset(rng.sample("abcdefghij", rng.choice([0, 1, 2, 3, 5]))) for _ in range(rng.randint(0, 14))] for _ in range(2))
        dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        for threshold in (0.35, 0.6):
            weight = lambda i, j: dice(old[i], new[j]) if dice(old[i], new[j]) >= threshold else 0
            assert [tuple(p) for p in al.alike(old, new, threshold).tolist()] == whole_table(len(old), len(new), weight)


def test_long_texts():
    """3,000 words on each side: the common ones are kept, in memory far below the table's 9 million cells."""
    rng = random.Random(3)
    old = [f"w{rng.randrange(600)}" for _ in range(3000)]
    new = [w if rng.random() < 0.8 else "new" for w in old if rng.random() < 0.95]
    tracemalloc.start()
    chunks = nar.diff_words(" ".join(old), " ".join(new))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    side = lambda kinds: "".join(c["v"] for c in chunks if c["t"] in kinds).split()
    assert side(("eq", "del")) == old and side(("eq", "ins")) == new
    assert len(side(("eq",))) >= sum(w != "new" for w in new) and peak < 60_000_000


def test_few_words_often():
    """Two kinds of words pair in a quarter of all places: rows, not points."""
    rng = np.random.default_rng(4)
    a, b = (["xyz"[k] for k in rng.integers(0, 3, 2000)] for _ in range(2))
    tracemalloc.start()
    pairs = al.matched(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(a[i] == b[j] for i, j in pairs) and (np.diff(pairs, axis=0) > 0).all() and len(pairs) > 1200 and peak < 20_000_000


def test_long_sections():
    """20,000 paragraphs, a few edited, moved or gone; unedited ones are never lost."""
    rng = random.Random(5)
    words = [f"term{k}" for k in range(5000)]
    old = [" ".join(rng.choices(words, k=12)) for _ in range(20_000)]
    new = [p + " indeed" if k % 50 == 0 else p for k, p in enumerate(old) if k % 97]
    tracemalloc.start()
    pairs = nar.align(old, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, _ in pairs if i >= 0] == list(range(len(old))) and [j for _, j in pairs if j >= 0] == list(range(len(new)))
    assert sum(i >= 0 and j >= 0 for i, j in pairs) == len(new) and peak < 300_000_000
