"""Operator 1: information-theoretic sanitisation of personal data.

Addresses, card and phone numbers are found by their form. Protected entities are each such value, with the windows of
words around it as its contexts, and each kind of value and all of them together, with the texts that hold one as
contexts. Corpus co-occurrence then tells which other terms give an entity away. With n_e distinct contexts of an entity,
n_te of them holding a term, n_t distinct texts holding the term and N distinct texts in all, the term's pointwise mutual
information with the entity is log2(n_te * N / (n_t * n_e)), and the entity's information content log2(N / n_e). Their
ratio is the share of the entity that the term discloses: 1 for a term that occurs next to the entity only. Terms above
the disclosure threshold, and not by chance, are personal data as well, wherever they occur: generalised to a class label,
or removed above a second threshold.

Terms are words and, for long words of letters and digits, their shapes: each key or token occurs once, its shape doesn't.
Equal windows count once and so do equal texts, so copies of a text neither disclose nor hide anything by their number.
Terms are counted in one pass, whatever their number; texts are never shuffled, only their digests with their terms.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import join_counted, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
#: Words of a context on either side of an entity.
WINDOW = 12
#: Distinct contexts that a term must share with an entity, and the share of its information from which the term is generalised or removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Log-likelihood that a term must have beyond that of the best of as many terms by chance.
SIGNIFICANCE = 4.0
#: Numbers that candidate terms are sifted by while texts are read: what is sent to the tasks for it is 1 MB.
BUCKETS = 1 << 20
#: Disclosing terms that are sent to the tasks at once (about 50 MB).
BLOCK_TERMS = 500_000
#: Shortest word that has a shape.
LEAST_SHAPE = 12
#: Shortest term, in characters.
LEAST_TERM = 3
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "cut": ""}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start inside a run of digits: the run's first digit would match as well. So long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each `@` with the characters before it, as far back as they or the last match reach."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data found by form, by kind and start; code points, end exclusive."""
    text = text or ""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> int:
    """Number of an entity: its kind and its value without case, blanks and marks (addresses keep their dots)."""
    plain = value.lower() if kind in ("email", "ip", "kind") else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}".encode("utf-8", "surrogatepass")) >> 1


def shape(word: str) -> str | None:
    """What a long word of letters and digits looks like; None for other words."""
    if len(word) < LEAST_SHAPE or word.isalpha() or word.isdecimal():
        return None
    return f"#{'hex' if not word.strip('0123456789abcdef') else 'mixed'}{len(word)}"


def terms_of(words: Iterable[str]) -> set[str]:
    """The terms among lower-case words: the words that are long enough, and shapes."""
    kinds = {w for w in words if len(w) >= LEAST_TERM}
    return kinds | {x for w in kinds if len(w) >= LEAST_SHAPE and (x := shape(w))}


def number(value: str) -> int:
    """Spark's xxhash64 of a string."""
    n = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 42)
    return n - (1 << 64) if n >> 63 else n


def contexts(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(entity, number of its context, distinct terms there) of each entity in a text, then of each kind and of all kinds."""
    found = base_spans(text)
    if not found:
        return
    hidden = sorted((a, b) for _, a, b in found)
    words, starts = [], []
    k = 0
    for m in WORD.finditer(text):
        while k < len(hidden) and hidden[k][1] <= m.start():
            k += 1
        if k == len(hidden) or m.end() <= hidden[k][0]:
            words.append(m[0].lower())
            starts.append(m.start())
    place = np.array(starts, np.int64)
    for kind, a, b in found:
        before, after = int(np.searchsorted(place, a)), int(np.searchsorted(place, b))
        near = words[max(0, before - WINDOW) : before] + words[after : after + WINDOW]
        yield entity(kind, text[a:b]), xxhash.xxh64_intdigest(" ".join(near).encode("utf-8", "surrogatepass")) >> 1, sorted(terms_of(near))
    whole, own = number(text), sorted(terms_of(words))
    for kind in sorted({kind for kind, _, _ in found}):
        yield entity("kind", kind), whole, own
    yield entity("kind", "any"), whole, own


def disclosures(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term, disclosed, entity): terms and the largest share of an entity that they disclose, at least `generalise`."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for t in batch["text"] for r in contexts(t)]
            yield pd.DataFrame(rows, columns=["entity", "context", "terms"])

    seen = stored(docs.select("text").mapInPandas(windows, "entity long, context long, terms array<string>").dropDuplicates(["entity", "context"]))
    of_entity = seen.groupBy("entity").agg(F.count("*").alias("n_e"))
    shared = seen.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support)
    # The entities that stand for all values of a kind, or for any value, meet most terms: their figures are broadcast.
    shared = stored(shared)
    figures = shared.groupBy("entity").agg(F.count("*").alias("size")).join(of_entity, "entity")
    candidates = stored(join_counted(shared, figures, "entity", "size", shared.count(), "inner").withColumn("number", F.xxhash64("term")))
    total, tried = docs.select(digest(F.col("text"))).distinct().count(), candidates.count()
    measured = candidates.join(term_counts(docs, candidates), "number")
    # A term can't share more texts with an entity than it has: repeats within a text are set aside.
    k, n, share = F.least("n_te", "n_t"), F.col("n_t"), F.least(F.col("n_e"), F.lit(total)) / F.lit(float(max(1, total)))
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    gain = part(k, n * share) + part(n - k, n * (1 - share))
    disclosed = F.when(share < 1, F.log2(k / (n * share)) / -F.log2(share)).otherwise(0.0)
    scored = measured.withColumn("disclosed", disclosed).filter((F.col("disclosed") >= generalise) & (gain >= math.log(max(1, tried)) + SIGNIFICANCE))
    return scored.groupBy("term").agg(F.max("disclosed").alias("disclosed"), F.max_by("entity", "disclosed").alias("entity"))


def term_blocks(terms: DataFrame, spark: SparkSession, size: int = BLOCK_TERMS) -> Iterator[object]:
    """Broadcast the first column's terms, with the second column's numbers if there is one, block by block."""
    block: dict[str, float] = {}
    for row in terms.toLocalIterator():
        block[row[0]] = row[1] if len(row) > 1 else 0.0
        if len(block) == size:
            yield spark.sparkContext.broadcast(block)
            block = {}
    if block:
        yield spark.sparkContext.broadcast(block)


def digest(text: Column) -> Column:
    """Digest by which equal texts count once; null and empty texts are equal."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest")


def term_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(number, n_t): distinct texts that hold each candidate term, by the term's number; others may be counted as well.

    The tasks know the candidates by a table of BUCKETS bits; the fuller it is, the more other terms are counted along.
    """
    sieve = np.zeros(BUCKETS, bool)
    sieve[[r[0] for r in candidates.select(F.pmod("number", F.lit(BUCKETS)).alias("b")).distinct().collect()]] = True  # at most BUCKETS rows
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = np.fromiter(map(number, terms_of(WORD.findall((text or "").lower()))), np.int64)
                rows.append(own[known[own % BUCKETS]])
            yield pd.DataFrame({"digest": batch["digest"], "terms": rows})[[len(r) > 0 for r in rows]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # the terms of a text are distinct
            terms, times = np.unique(np.concatenate([np.zeros(0, np.int64), *batch["terms"]]), return_counts=True)
            yield pd.DataFrame({"number": terms, "n": times})

    distinct = docs.select("text", digest(F.col("text"))).mapInPandas(held, "digest binary, terms array<long>").dropDuplicates(["digest"])
    return distinct.select("terms").mapInPandas(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n_t"))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_column(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in base_spans(t)] for t in texts], dtype=object)

    return find(text)


def with_terms(text: Column, spans: Column, sent, remove: float = REMOVE) -> Column:
    """The spans, and those of a block's terms outside all spans so far: kind `term` (generalise) or `cut` (remove)."""

    @F.pandas_udf(SPANS)
    def add(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = sent.value
        for texts, found in batches:
            out = []
            for t, own in zip(texts, found):
                own = [dict(s) for s in own]
                if (t := t or "") and known.keys() & terms_of(WORD.findall(t.lower())):
                    taken = sorted((s["start"], s["end"]) for s in own)
                    k, more = 0, []
                    for m in WORD.finditer(t):
                        while k < len(taken) and taken[k][1] <= m.start():
                            k += 1
                        w = m[0].lower()
                        share = max(known.get(w, 0.0), known.get(shape(w), 0.0))
                        if share and (k == len(taken) or m.end() <= taken[k][0]):
                            more.append({"kind": "cut" if share >= remove else "term", "start": m.start(), "end": m.end()})
                    own += more
                out.append(own)
            yield pd.Series(out, dtype=object)

    return add(text, spans)


def find_private(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Every row with `private_spans`: by form first (by kind, start), then the disclosing terms'.

    Null and empty texts have no spans; texts of any length are read whole. Repeated rows are all kept, but their equal
    contexts count once. Of terms that disclose several entities the largest share counts. An existing column of that
    name is replaced; no other column is read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("private_spans")
    terms = disclosures(docs, support, generalise)
    out = docs.withColumn("private_spans", base_column(F.col("text")))
    for sent in term_blocks(terms.select("term", "disclosed"), docs.sparkSession):
        out = out.withColumn("private_spans", with_terms(F.col("text"), F.col("private_spans"), sent, remove))
    return out


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents with every private span replaced by its class label, or cut out. Other columns are kept."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            out = []
            for t, own in zip(texts, found):
                if t is not None:
                    parts, at = [], 0
                    for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [t[at : s["start"]], LABELS[s["kind"]]]
                        at = max(at, s["end"])
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pd.Series(out, dtype=object)

    return find_private(docs, **limits).withColumn("text", clean(F.col("text"), F.col("private_spans"))).select(*docs.columns)


def op1_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("private_spans", lambda s: s["kind"].isin(*KINDS))
    number = lambda kind: F.size(F.filter("private_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("private_spans")).alias("spans"))
