"""Operator 6: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums over their common character subsequences of a fixed length, each weighted down by the
length it spans in both, so "i.d*i o t" still shares most of the subsequences of the word it hides. Normalised values
below CUT are chance and count as 0. The kernel of a sentence with a landmark is the sum over the sentence's different
words; these sums over all landmarks, whitened by the landmarks' own kernel matrix, are the features of a linear support
vector machine, trained on labelled sentences: a sentence has its document's label, and of a toxic document the sentences
that hold a string like a toxic landmark, or that are toxic by the model so far, are its witnesses. A text's score comes
from its three most toxic different sentences, so that one plain insult and several doubtful ones both count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import small_batches, stored

#: Length of the common subsequences; weight of each character that a subsequence spans; least value that counts.
LENGTH, DECAY, CUT = 4, 0.95, 0.36
#: Labelled rows that are learned from, at most: the first by a hash of their ids.
TRAIN_ROWS = 8_000
#: Landmarks: at most so many toxic strings, and half as many of clean texts that are most like those.
LANDMARKS = 48
#: A toxic landmark occurs in toxic texts so many times as often as all strings do.
LIFT = 3
#: Different words up to which a text counts as short.
SHORT = 32
#: Kernel from which a landmark says nothing that another doesn't.
REDUNDANT = 0.6
#: Landmarks that begin with so many equal characters are compared in one pass.
SHARED = 4
#: Longest string; longer words are cut into windows that overlap by half.
LONGEST = 20
#: Lengths of the beginnings of words that may be landmarks: stems stand for all their forms.
STEMS = (5, 7)
#: Sentences of a labelled row that training sees: those most like a landmark.
WITNESSES = 8
#: Labelled sentences that a made one, a bent insult, counts as.
BENT = 5
#: Weight of all made examples in the score's scale, as a share of the toxic rows.
MADE = 0.1
#: Sentences that a text's score rests on.
TOP = 3
#: Words that a task remembers the features of, at most twice as many; strings that are compared at once.
MEMORY, TOGETHER = 200_000, 4096

SENTENCE = re.compile(r"(?<=[.!?;:|])\s+|\n+")
SINGLES = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
#: Marks that may hide inside a word are dropped; all others separate words, or hide inside them as well.
INSIDE = b".-_*'~+`^#$%&@"
APART = b'/,;:|"()[]{}<>?!=\\'
SEPARATE = bytes.maketrans(APART, b" " * len(APART))
PAD = 0
#: Marks of a word's first and last place: subsequences through them tell a beginning or end from a middle.
FIRST, LAST = "\x02", "\x03"


def tokens(text: str | None) -> list[bytes]:
    """What blanks separate, in lower case."""
    return (text or "").lower().encode("utf-8", "replace").split()


def joined_singles(text: str | None, found: set[bytes]) -> set[bytes]:
    """Runs of three or more single characters, as the words that they spell."""
    single = [t for t in found if len(t) < 5 and (len(t) == 1 or (t[0] > 0xC1 and len(t.decode("utf-8", "replace")) == 1))]
    if len(single) < 2:  # no word is one character over and over
        return set()
    return {"".join(m[0].split()).encode("utf-8", "replace") for m in SINGLES.finditer((text or "").lower())}


def words_of(token: bytes) -> set[bytes]:
    """The words that a token may stand for: its parts between separating marks, and itself without any marks."""
    parts = token.translate(SEPARATE, INSIDE).split()
    return {*parts, b"".join(parts)} if len(parts) != 1 else {parts[0]}


def strings_of(word: bytes) -> list[str]:
    """What a word is compared as: itself between marks of its ends, or overlapping windows if it is overlong."""
    w = FIRST + word.decode("utf-8", "replace") + LAST
    if len(w) > LONGEST:
        return [w[a : a + LONGEST] for a in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return [w] if len(w) > LENGTH else []


def strings(text: str | None) -> set[str]:
    """The distinct strings of a text."""
    found = set(tokens(text))
    return {x for t in found | joined_singles(text, found) for w in words_of(t) for x in strings_of(w)}


def contexts(text: str | None) -> set[tuple[str, int]]:
    """Distinct pairs of a string, a word or the beginning of one, and a checksum of what it stands in."""
    found = [w for t in tokens(text) for w in t.translate(SEPARATE, INSIDE).split()]
    out = set()
    for before, w in zip([b"", *found], found):
        if len(x := strings_of(w)) == 1:
            out.add((x[0], crc32(before) >> 1))
            out.update((x[0][: n + 1], crc32(before + w) >> 1) for n in STEMS if len(x[0]) > n + 2)
    return out


def codes(words: Sequence[str]) -> np.ndarray:
    """Characters as numbers, one row a word, padded with PAD."""
    raw = np.array(list(words), dtype=f"<U{LONGEST}") if len(words) else np.zeros(0, f"<U{LONGEST}")
    return raw.view(np.uint32).reshape(len(raw), LONGEST)


def kernel(a: np.ndarray, b: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Subsequence kernel of the rows of `a` with the rows of `b` (one for each, or one for all), pair by pair.

    S[p][i, j] sums all common subsequences of length p that end at i or before and j or before, weighted by their
    spans up to there; each step extends them by one matching character. Pairs lie along the last axis.
    """
    out = np.zeros(len(a))
    for k in range(0, len(a), chunk):
        x, y = a[k : k + chunk].T, (b if len(b) == 1 else b[k : k + chunk]).T
        x, y = (z[: max(1, int((z != PAD).sum(axis=0).max(initial=1)))] for z in (x, y))
        ends = same = ((x[:, None] == y[None]) & (x[:, None] != PAD)).astype(np.float32) * np.float32(DECAY**2)
        for _ in range(LENGTH - 1):
            reach = ends.copy()
            for i in range(1, len(x)):
                reach[i] += np.float32(DECAY) * reach[i - 1]
            for j in range(1, len(y)):
                reach[:, j] += np.float32(DECAY) * reach[:, j - 1]
            ends = np.zeros_like(same)
            ends[1:, 1:] = same[1:, 1:] * reach[:-1, :-1]
        out[k : k + chunk] = ends.sum(axis=(0, 1), dtype=np.float64)
    return out


def tree_kernel(a: np.ndarray, letters: np.ndarray, parents: list[int], chunk: int = 256) -> np.ndarray:
    """Subsequence kernel of the rows of `a` with all strings of a tree: a column for each node, the string from the root to it.

    As `kernel`, but strings with a common beginning share its steps. A node's parent stands before it; roots have -1.
    """
    out = np.zeros((len(a), len(letters)))
    for k in range(0, len(a), chunk):
        x = a[k : k + chunk].T
        x = x[: max(1, int((x != PAD).sum(axis=0).max(initial=1)))]
        ends = same = ((letters[:, None, None] == x[None]) & (x[None] != PAD)).astype(np.float32) * np.float32(DECAY**2)
        for _ in range(LENGTH - 1):
            reach = ends.copy()
            for i in range(1, len(x)):
                reach[:, i] += np.float32(DECAY) * reach[:, i - 1]
            for j, parent in enumerate(parents):
                if parent >= 0:
                    reach[j] += np.float32(DECAY) * reach[parent]
            ends = np.zeros_like(same)
            for j, parent in enumerate(parents):
                if parent >= 0:
                    np.multiply(same[j, 1:], reach[parent, :-1], out=ends[j, 1:])
        total = ends.sum(axis=1, dtype=np.float64)
        for j, parent in enumerate(parents):
            if parent >= 0:
                total[j] += total[parent]
        out[k : k + chunk] = total.T
    return out


def trees(marks: Sequence[str]) -> list[tuple[list[int], list[int], np.ndarray, list[int]]]:
    """Strings by their first SHARED characters: (numbers of the strings, their nodes, letters, parents) of each tree."""
    groups: dict[str, list[int]] = {}
    for j, w in enumerate(marks):
        groups.setdefault(w[:SHARED], []).append(j)
    out = []
    for own in groups.values():
        nodes: dict[str, int] = {}
        for w in (marks[j][:n] for j in own for n in range(1, len(marks[j]) + 1)):
            nodes.setdefault(w, len(nodes))
        out.append((own, [nodes[marks[j]] for j in own], np.array([ord(w[-1]) for w in nodes], np.uint32), [nodes.get(w[:-1], -1) for w in nodes]))
    return out


class Marks:
    """Landmark strings and their kernel with other strings.

    By the Cauchy-Schwarz inequality a normalised kernel is at most the root of the share that those subsequences of the
    landmark have in its own kernel whose characters all occur in the other string. Where that share is below CUT squared
    the kernel is too, and isn't computed. The share depends on which of the landmark's characters a string holds; it is
    computed when such a set is first met, and kept.
    """

    def __init__(self, marks: Sequence[str]) -> None:
        self.rows, self.trees = codes(marks), trees(marks)
        self.norm = kernel(self.rows, self.rows)
        unlike = np.tril(np.arange(1, LONGEST + 1, dtype=np.uint32) * np.ones((LONGEST + 1, 1), np.uint32), -1)
        self.least = kernel(unlike, unlike)  # of strings of each length without a repeated character
        self.alphabet = np.unique(self.rows[self.rows != PAD])
        self.own = [np.unique(row[row != PAD]) for row in self.rows]
        self.places = [np.searchsorted(self.alphabet, own) for own in self.own]
        self.possible = [np.zeros(1 << len(own), np.int8) for own in self.own]  # 0: not met yet, 1: no, 2: yes; pages never met take no memory

    def may_match(self, j: int, held: np.ndarray) -> np.ndarray:
        """Whether strings that hold these sets of landmark j's characters (one bit each) can reach CUT."""
        known, row = self.possible[j], self.rows[j]
        state = known[held]
        if not state.all():
            sets = np.unique(held[state == 0])
            kept = np.zeros((len(sets), LONGEST), bool)
            for bit, c in enumerate(self.own[j]):
                kept |= ((sets >> bit) & 1 == 1)[:, None] & (row == c)[None, :]
            # Characters outside the set become two different ones on the two sides, so they match nothing.
            share = kernel(np.where(kept | (row == PAD), row, 0x110000).astype(np.uint32), np.where(kept | (row == PAD), row, 0x110001).astype(np.uint32)) / self.norm[j]
            known[sets] = np.where(share >= 0.999 * CUT**2, 2, 1)
            state = known[held]
        return state == 2

    def similar(self, words: Sequence[str]) -> np.ndarray:
        """Normalised kernel (CUT to 1, or 0) of each word with each landmark."""
        out, rows = np.zeros((len(words), len(self.rows))), codes(words)
        if not len(rows):
            return out
        turn = np.argsort((rows != PAD).sum(axis=1), kind="stable")  # like lengths together: tables no wider than needed
        rows = rows[turn]
        # Which characters of the landmarks' alphabet each word holds, 60 to a number; then, for each landmark, its own.
        holds = []
        for k in range(0, len(self.alphabet), 60):
            bits = np.zeros(0x110000, np.int64)
            own = self.alphabet[k : k + 60]
            bits[own] = np.int64(1) << np.arange(len(own))
            holds.append(np.bitwise_or.reduce(bits[rows], axis=1))
        own, least = np.zeros(len(rows)), self.least[(rows != PAD).sum(axis=1)]
        for js, nodes, letters, parents in self.trees:
            may = np.zeros((len(js), len(rows)), bool)
            for n, j in enumerate(js):
                held = np.zeros(len(rows), np.int64)
                for k, place in enumerate(self.places[j].tolist()):
                    held |= ((holds[place // 60] >> (place % 60)) & 1) << k
                may[n] = self.may_match(j, held)
            at = np.flatnonzero(may.any(axis=0))
            value = tree_kernel(rows[at], letters, parents)
            # A string's own kernel is that of as many different characters, or more: most are told by that alone.
            near = (value[:, nodes] >= 0.999 * CUT * np.sqrt(least[at, None] * self.norm[js])).any(axis=1)
            at, value = at[near], value[near]
            new = at[own[at] == 0]
            own[new] = kernel(rows[new], rows[new])
            for n, j in enumerate(js):
                scale = np.sqrt(own[at] * self.norm[j])
                like = np.divide(value[:, nodes[n]], scale, out=np.zeros(len(at)), where=scale > 0)
                out[turn[at], j] = np.where((like >= CUT) & may[n, at], like, 0.0)
        return out


@dataclass
class Model:
    """Landmarks and what the machine weighs them with; `slopes` and `offset` turn the values of a text's sentences into its score."""

    marks: list[str]
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def __post_init__(self) -> None:
        self.table = Marks(self.marks)
        self.memory: dict[bytes, np.ndarray | None] = {}
        self.older: dict[bytes, np.ndarray | None] = {}

    def features(self, found: set[bytes]) -> dict[bytes, np.ndarray | None]:
        """Kernel of each token with each landmark, by the likest of its strings; None where all are 0."""
        if len(self.memory) > MEMORY:  # words that come again move on, the others are forgotten
            self.older, self.memory = self.memory, {}
        known, older = self.memory, self.older
        known.update((t, older[t]) for t in found if t in older and t not in known)
        new = [t for t in found if t not in known]
        known.update(dict.fromkeys(new))
        pairs = [(t, x) for t in new for w in words_of(t) for x in strings_of(w)]
        for k in range(0, len(pairs), TOGETHER):
            part = pairs[k : k + TOGETHER]
            like = self.table.similar([x for _, x in part]).astype(np.float32)
            for at in np.flatnonzero(like.any(axis=1)).tolist():  # most words are unlike all landmarks
                t = part[at][0]
                known[t] = like[at].copy() if known[t] is None else np.maximum(known[t], like[at])  # a view would keep all of `like`
        return known

    def sentences(self, texts: Sequence[str | None]) -> list[tuple[list[np.ndarray], int]]:
        """For each text the kernel sums of its different sentences that hold anything like a landmark, and its number of different words."""
        found, spelt = [], []
        for t in texts:
            own = set(tokens(t))
            spelt.append(joined_singles(t, own))
            found.append(own | spelt[-1])
        known, out = self.features(set().union(*found)), []
        for text, own, singles in zip(texts, found, spelt):
            hits = {t for t in own if known[t] is not None}
            kinds = {}
            for sentence in SENTENCE.split(text) if hits else ():
                held = hits.intersection(inside := tokens(sentence))
                if singles:  # else no sentence has any
                    held |= joined_singles(sentence, set(inside)) & hits
                if held and (held := frozenset(held)) not in kinds:
                    kinds[held] = np.sum([known[t] for t in held], axis=0) if len(held) > 1 else known[next(iter(held))]
            out.append((list(kinds.values()), len(own)))
        return out

    def values(self, sums: list[np.ndarray], size: int) -> np.ndarray:
        """The TOP greatest values of a text's sentences, then its size: the more words, the more look alike by chance.

        A text with fewer sentences has the values of sentences without any known string.
        """
        own = sorted(np.array(sums) @ self.weights + self.bias, reverse=True) if sums else []
        return np.array([*np.maximum([*own, *[self.bias] * TOP][:TOP], self.bias), np.log(max(size, SHORT))])

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        if not self.marks:
            return np.full(len(texts), 1 / (1 + np.exp(-self.offset)))
        logit = np.array([self.values(*s) @ self.slopes for s in self.sentences(texts)]) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def unlike(marks: Sequence[str], most: int) -> list[str]:
    """The first of these strings that aren't much like one taken before."""
    taken: list[str] = []
    while marks and len(taken) < most:
        taken.append(marks[0])
        like = Marks(marks[:1]).similar(marks)[:, 0]
        marks = [w for w, k in zip(marks[1:], like[1:]) if k < REDUNDANT]
    return taken


def base_rate(n_toxic: int, n: int) -> Model:
    """Where nothing tells toxic texts apart, all have the base rate, but none is called toxic for that alone."""
    rate = min(0.49, (n_toxic + 0.5) / (n + 2))
    return Model([], np.zeros(0), 0.0, np.zeros(TOP + 1), float(np.log(rate / (1 - rate))))


def fit_svm(features: np.ndarray, sign: np.ndarray, close: np.ndarray, rounds: int = 4, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine (squared hinge loss, Newton steps) on all sentences of clean rows and the witnesses of toxic ones.

    Witnesses are the sentences close to a toxic landmark, and those that the machine so far calls toxic. A toxic row
    may have none: labels err, and rare insults have no landmark.
    """
    x = np.hstack([features, np.ones((len(features), 1), features.dtype)])
    ridge = penalty * np.diag([1.0] * features.shape[1] + [1e-3])
    weight, witness = np.zeros(x.shape[1]), (sign < 0) | close
    for _ in range(rounds):
        share = 1 / max(1, int((witness & (sign > 0)).sum()))
        last = None
        for _ in range(30):
            active = witness & (sign * (x @ weight) < 1)
            if last is not None and (active == last).all():
                break
            last, part = active, x[active]
            weight = np.linalg.solve((share * part.T @ part).astype(np.float64) + ridge, share * (part.T @ sign[active]).astype(np.float64))
        witness = (sign < 0) | close | (x @ weight > 0)
    return weight[:-1], float(weight[-1])


def calibrate(values: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (none below 0 but the last, the size's) and offset that turn values into a probability: logistic regression by Newton steps."""
    used = np.ones(values.shape[1], bool)
    while True:
        x = np.hstack([values[:, used], np.ones((len(values), 1))])
        beta, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
        loss = lambda b, x=x: float(weight @ (np.logaddexp(0, x @ b) - toxic * (x @ b)) + 5e-3 * b @ b)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (toxic - p)) - 1e-2 * beta)
            while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
                step = step / 2
            beta = beta + step
        low = np.concatenate([beta[:-2] < 0, [False]])
        if not low.any():
            slopes = np.zeros(values.shape[1])
            slopes[used] = beta[:-1]
            return slopes, float(beta[-1])
        used[np.flatnonzero(used)[low]] = False


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Model of the labelled rows (doc_id, text) x (doc_id, toxic). Only a bounded sample of labelled rows is read.

    Landmarks are the strings whose contexts are toxic most significantly (likelihood ratio), and of the widespread
    other ones those most like them. Counts are made in Spark; the driver gets a few sentences a row, as numbers. Null
    labels and ids teach nothing; copies of a text are one example, toxic if any is labelled so; without labels of both
    kinds, or without a toxic string, the model is the base rate.
    """
    small_batches(docs.sparkSession)
    taught = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)
    # At most train_rows rows of two numbers.
    sample = docs.join(F.broadcast(taught), F.col("doc_id") == F.col("_id")).select("doc_id", F.least("toxic", F.lit(1)).cast("long").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = stored(sample.groupBy(F.xxhash64("text").alias("_copy")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text")).drop("_copy"))
    n, n_toxic = cuts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return base_rate(n_toxic, n)

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                own = batch.iloc[k : k + 100]
                rows = [(i, y, w, b) for i, y, t in zip(own["doc_id"], own["toxic"], own["text"]) for w, b in contexts(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "toxic", "word", "before"])

    # A string and what it stands in belong to the first row that has them, and a string counts the rows that own one of
    # its pairs: so neither near copies nor repetitions within a row make strings toxic.
    pairs = cuts.mapInPandas(paired, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic long, word string, before long")
    owners = pairs.groupBy("word", "before", "toxic").agg(F.min("doc_id").alias("owner")).select("word", "toxic", "owner").distinct()
    seen = stored(owners.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).filter("p + q >= 3"))
    n_words, all_p, all_q = seen.agg(F.count("*"), F.sum("p"), F.sum("q")).first()
    part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    p, q, share = F.col("p"), F.col("q"), (all_p or 1) / ((all_p or 1) + (all_q or 0))
    gain = part(p, (p + q) * share) + part(q, (p + q) * max(1e-9, 1 - share))
    # Significant although so many strings were tried (twice the gain is a chi-squared value).
    offered = {r[0]: (r[1], r[2]) for r in seen.filter((p > LIFT * share * (p + q)) & (gain > np.log(n_words + 1) + 4)).orderBy(gain.desc(), "word").limit(8 * landmarks).collect()}
    toxic_marks = unlike(list(offered), landmarks)
    if not toxic_marks:
        return base_rate(n_toxic, n)
    others = [r[0] for r in seen.filter(p <= LIFT * share * (p + q)).orderBy(q.desc(), "word").limit(100 * landmarks).collect()]
    like = Marks(toxic_marks).similar(others).max(axis=1, initial=0)
    marks = [*toxic_marks, *[others[k] for k in np.argsort(-like, kind="stable")[: landmarks // 2] if like[k] > 0]]
    model, n_toxic_marks = Model(marks, np.zeros(len(marks)), 0.0, np.zeros(TOP + 1), 0.0), len(toxic_marks)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                own = batch.iloc[k : k + 200]
                found = model.sentences(own["text"].tolist())
                best = [sorted(s, key=lambda v: -v[:n_toxic_marks].max())[:WITNESSES] for s, _ in found]
                yield pd.DataFrame({"toxic": own["toxic"], "size": [n for _, n in found], "sums": [[v.tolist() for v in s] for s in best]})

    kept = cuts.mapInPandas(nearest, "toxic long, size long, sums array<array<float>>").collect()
    gram = model.table.similar(marks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3 * value.max()))) @ vector.T
    # Whole words that clean texts hardly hold, with one or two characters put in, teach how far an insult may be bent.
    sure = [w for w in toxic_marks if w[-1] == LAST and 10 * offered[w][1] <= offered[w][0]]
    bent = [w[:k] + c + w[k:] for w in sure for k in range(2, len(w) - 1) for c in ("x", "xx") if len(w) + len(c) <= LONGEST]
    likes = [v for v in model.table.similar([*sure, *bent]) if v.any()]
    sums = np.array([s for r in kept for s in r["sums"]] + BENT * likes, np.float64).reshape(-1, len(marks))
    sign = np.array([1.0 if r["toxic"] else -1.0 for r in kept for _ in r["sums"]] + BENT * len(likes) * [1.0])
    # Sentences without any known string are all alike: one example of them for each clean row.
    sums, sign = np.vstack([sums, np.zeros((n - n_toxic, len(marks)))]), np.concatenate([sign, np.full(n - n_toxic, -1.0)])
    weight, bias = fit_svm(sums @ whiten, sign, sums[:, :n_toxic_marks].max(axis=1, initial=0) > 0.6)
    model = Model(marks, whiten @ weight, bias, np.zeros(TOP + 1), 0.0)
    sizes = [r["size"] for r in kept if r["toxic"]]
    top = np.array([model.values([np.array(s) for s in r["sums"]], r["size"]) for r in kept] + [model.values([v], sizes[k % len(sizes)]) for k, v in enumerate(likes)])
    truth = np.array([float(r["toxic"]) for r in kept] + [1.0] * len(likes))
    # The made ones weigh as much as a part of the toxic rows: they mustn't outvote how many words a toxic text has.
    model.slopes, model.offset = calibrate(top, truth, np.array([1.0] * len(kept) + [MADE * n_toxic / max(1, len(likes))] * len(likes)))
    return model


def score_column(text: Column, model: Model, spark: SparkSession) -> Column:
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # a few landmarks and weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in batches:
            values = texts.tolist()
            yield pd.Series(np.concatenate([own.scores(values[k : k + 256]) for k in range(0, len(values), 256)]) if values else np.zeros(0))

    return score(text)


def held_out() -> Column:
    """Rows that training never sees: a fifth, by the checksum of the id. Null ids count as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the score of a text without known strings; repeated rows are scored each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.filter(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model calls toxic go. The model learns as in the query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs.select("doc_id", "text"), labels.filter(~held_out()))
    return docs.filter(score_column(F.col("text"), model, spark) < 0.5)
