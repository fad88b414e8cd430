"""Operator 5: exact substring deduplication by external induced sorting.

A byte goes if it lies in a string of SPAN bytes that also starts anywhere else. Suffix sorting finds those strings:
neighbours in suffix order with a common prefix of SPAN bytes or more. It runs in three parts.

1. Sample, as induced sorting reduces a text to sampled substrings and names them: of the GRAM-byte strings inside each
   SPAN-byte window, the one with the smallest hash is the window's anchor. Equal windows have equal anchors at equal
   offsets, so only windows of equally named anchors need comparing. Names that occur once end here, without their texts
   ever moving. A name stands with its context, the bytes that all windows of its anchor cover; names with a single
   context are copies, and so are contexts that occur twice: all their windows repeat.
2. Recurse where a name has many different contexts: each of PARTS parts of its windows is named by the longer string
   that those share, and the same rules apply to the new names. A name as long as a window has one context only, so this ends, and
   no name is left with more than SPLIT contexts however often a passage occurs.
3. The contexts that are left are the shards of the suffix sort. Starting from empty suffixes at the contexts' ends, the
   order of the suffixes one byte longer is induced from the order so far: tuples (group, context, common prefix) pass a
   priority queue on disk and leave it in their new order, with the common prefix of neighbours carried along (`Shard`).

Names and contexts are told apart by 64-bit hashes; windows inside differing contexts by their bytes.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import join_counted, stored, with_row_ids

#: Bytes of a repeated string, and of the sampled substrings that name anchors.
SPAN, GRAM = 400, 200
#: Anchors lie at most so far behind a window's start.
REACH = SPAN - GRAM
#: Columns of aligned contexts.
WIDTH = REACH + SPAN
#: Contexts of a name above which it is split by longer names.
SPLIT = 512
#: Ranges that its windows are split into; three rounds end with single windows.
PARTS = 8
#: Tuples of a block of the external sort; bytes its queue holds before it goes to disk.
BLOCK, QUEUE_BYTES = 4096, 64 << 20
#: Longest stretch of a document that is hashed at once (positions share a number with hashes).
STRETCH = 1 << 19

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOW = np.uint64((1 << 20) - 1)
VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the rolling hash's base and its inverse, made once per worker."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, BASE)]))
            cls.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, INVERSE)]))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` numbers, by minima up to and from the borders of blocks of that width."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[width - 1 : width - 1 + n])


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(position, first window start, last window start, name, context hash) of the anchors of a text, as arrays."""
    with np.errstate(over="ignore"):
        for begin in range(0, max(0, len(data) - SPAN + 1), STRETCH):
            own = np.frombuffer(data, np.uint8)[begin : begin + STRETCH + SPAN - 1]
            Powers.upto(len(own) + 1)
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(VALUE[own] * Powers.down[: len(own)], out=total[1:])
            gram = scramble((total[GRAM:] - total[:-GRAM]) * Powers.up[: len(own) - GRAM + 1])
            key = (gram & ~LOW) | np.arange(len(gram), dtype=np.uint64)
            chosen = (least_in_windows(key, REACH + 1) & LOW).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
            last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
            at = chosen[first]
            context = (total[last + SPAN] - total[first]) * Powers.up[first]
            context = scramble(context ^ ((at - first).astype(np.uint64) << np.uint64(32)) ^ ((last - first).astype(np.uint64) << np.uint64(48)))
            yield at + begin, first + begin, last + begin, gram[at].view(np.int64), context.view(np.int64)


def aligned(contexts: list[bytes], before: np.ndarray) -> np.ndarray:
    """Contexts as rows of numbers (byte + 1; 0 outside), their anchors below each other in column REACH."""
    out = np.zeros((len(contexts), WIDTH), np.uint16)
    for k, c in enumerate(contexts):
        at = REACH - int(before[k])
        out[k, at : at + len(c)] = np.frombuffer(c, np.uint8).astype(np.uint16) + 1
    return out


class Shard:
    """External induced sorting of the contexts of one task: bytes, order, queue and places lie in files of a folder.

    The order is a file of suffix tuples (group, context, common prefix with the tuple before), sorted by group and by
    the suffixes that start in the current column. Taking in the column before, each tuple passes a priority queue keyed
    by (group, byte, place so far) and leaves it in its new order; two neighbours with the same byte have one byte more
    in common than the least of all common prefixes between their places. Groups that end inside a block of the file
    leave the queue at once; the tuples of a group that goes on wait in it, one run for each byte, and go to disk when
    they take more than `queue_bytes`. In memory are a block, the queue's newest tuples and four bytes a context.
    """

    def __init__(self, folder: str, queue_bytes: int = QUEUE_BYTES, block: int = BLOCK) -> None:
        self.folder, self.queue_bytes, self.block = folder, queue_bytes, block
        self.count, self.groups, self.name = 0, 0, None

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def append(self, name: str, values: np.ndarray) -> None:
        with open(self.path(name), "ab") as f:
            values.tofile(f)

    def add(self, contexts: list[bytes], before: np.ndarray, names: np.ndarray, row: np.ndarray, at: np.ndarray) -> None:
        """Further contexts, in the order of their names, with the bytes before their anchors and the anchors' places."""
        fresh = names[1:] != names[:-1]
        first = self.name is None or names[0] != self.name
        group = self.groups + np.cumsum(np.concatenate([[first], fresh])) - 1
        self.groups, self.name = int(group[-1]) + 1, names[-1]
        self.append("rows", aligned(contexts, before))
        self.append("places", np.stack([row, at], axis=1).astype(np.int64))
        n = np.arange(self.count, self.count + len(names))
        self.append("order", np.stack([group, n, np.zeros_like(n)], axis=1).astype(np.int64))
        self.count += len(names)

    def turn(self) -> None:
        """Contexts as columns: a step reads one column from end to end."""
        rows = np.memmap(self.path("rows"), np.uint16, "r", shape=(self.count, WIDTH))
        columns = np.memmap(self.path("columns"), np.uint16, "w+", shape=(WIDTH, self.count))
        for k in range(0, self.count, self.block):
            columns[:, k : k + self.block] = rows[k : k + self.block].T
        columns.flush()

    def blocks(self) -> Iterator[np.ndarray]:
        with open(self.path("order"), "rb") as f:
            while len(part := np.fromfile(f, np.int64, 3 * self.block)):
                yield part.reshape(-1, 3)

    def induce(self, column: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of tuples in the order that the column before gives."""
        queue = Queue(self.path("queue"), self.queue_bytes)
        for tuples in self.blocks():
            byte, group = column[tuples[:, 1]], tuples[:, 0]
            begin, end = np.searchsorted(group, group[0], "right"), np.searchsorted(group, group[-1])
            if queue.group == group[0]:
                queue.push(byte[:begin], tuples[:begin])
            else:
                yield from queue.drain()
                begin = 0
            if begin < end:
                yield from queue.drain()
                yield whole_groups(tuples[begin:end], byte[begin:end])
            if begin <= end and end < len(group):
                yield from queue.drain()
                queue.push(byte[end:], tuples[end:])
        yield from queue.drain()

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """(distance, contexts whose window at that distance before the anchor occurs in another context of their group)."""
        self.turn()
        for c in range(WIDTH - 1, -1, -1):
            column = np.fromfile(self.path("columns"), np.uint16, self.count, offset=2 * c * self.count)
            found, before = [], -1
            with open(self.path("next"), "wb") as out:
                for tuples in self.induce(column):
                    tuples.tofile(out)
                    if c <= REACH and (long := tuples[:, 2] >= SPAN).any():
                        found.append(tuples[long | np.concatenate([long[1:], [False]]), 1])
                        if long[0]:
                            found.append(np.array([before]))
                    before = int(tuples[-1, 1])
            os.replace(self.path("next"), self.path("order"))
            if c <= REACH:
                yield REACH - c, np.concatenate(found) if found else np.zeros(0, np.int64)

    def spans(self) -> Iterator[pd.DataFrame]:
        """(row, from, to): the bytes of each run of found windows."""
        if not self.count:
            return
        places = np.memmap(self.path("places"), np.int64, "r", shape=(self.count, 2))
        since = np.full(self.count, -1, np.int16)

        def ended(which: np.ndarray, far: int) -> Iterator[pd.DataFrame]:
            for k in range(0, len(which), self.block):
                own = which[k : k + self.block]
                at = places[own, 1]
                yield pd.DataFrame({"row": places[own, 0], "from": at - far, "to": at - since[own] + SPAN})

        for distance, found in self.steps():
            now = np.zeros(self.count, bool)
            now[found] = True
            gone = np.flatnonzero(~now & (since >= 0))
            yield from ended(gone, distance - 1)
            since[gone] = -1
            since[now & (since < 0)] = distance
        yield from ended(np.flatnonzero(since >= 0), REACH)


def whole_groups(tuples: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """One step of the induction for groups that lie wholly in these tuples."""
    group, common = tuples[:, 0], tuples[:, 2]
    inside = np.concatenate([[False], group[1:] == group[:-1]])  # groups keep their places
    if (byte[1:] == byte[:-1])[inside[1:]].all():
        fresh, order = np.where(inside & (byte > 0), common + 1, 0), tuples
    else:
        place = np.argsort(group * 512 + byte, kind="stable")
        order, taken = tuples[place], byte[place]
        same = inside & np.concatenate([[False], taken[1:] == taken[:-1]]) & (taken > 0)
        fresh = np.zeros(len(order), np.int64)
        if same.any():
            to = np.flatnonzero(same)
            fresh[to] = 1 + np.minimum.reduceat(np.append(common, 0), np.stack([place[to - 1] + 1, place[to] + 1], axis=1).ravel())[::2]
    return np.stack([order[:, 0], order[:, 1], fresh], axis=1)


class Queue:
    """Priority queue of the tuples of one group, by byte and place; one file for each byte once memory is full."""

    def __init__(self, path: str, most: int) -> None:
        self.path, self.most, self.group = path, most, None
        self.clear()

    def clear(self) -> None:
        self.group, self.held, self.waiting, self.files = None, 0, {}, {}
        self.since: dict[int, int] = {}  # least common prefix since a byte's last tuple

    def push(self, byte: np.ndarray, tuples: np.ndarray) -> None:
        """The group's next tuples, in the order so far."""
        self.group, common = tuples[0, 0], tuples[:, 2]
        kinds = np.unique(byte).tolist()
        for b in kinds:
            at = np.flatnonzero(byte == b)
            starts = np.concatenate([[0], at[:-1] + 1])
            least = np.minimum.reduceat(np.append(common, 0), np.stack([starts, at + 1], axis=1).ravel())[::2]
            fresh = least + 1 if b else np.zeros(len(at), np.int64)
            fresh[0] = min(self.since[b], int(least[0])) + 1 if b and b in self.since else 0
            self.waiting.setdefault(b, []).append(np.stack([tuples[at, 0], tuples[at, 1], fresh], axis=1))
            self.since[b] = int(common[at[-1] + 1 :].min(initial=WIDTH))
        low = int(common.min())
        for b in self.since.keys() - set(kinds):
            self.since[b] = min(self.since[b], low)
        self.held += tuples.nbytes
        if self.held > self.most:
            for b, parts in self.waiting.items():
                with open(f"{self.path}-{b}", "ab") as f:
                    for p in parts:
                        p.tofile(f)
                self.files[b] = f"{self.path}-{b}"
            self.waiting, self.held = {}, 0

    def drain(self) -> Iterator[np.ndarray]:
        for b in sorted(self.since):
            if b in self.files:
                with open(self.files[b], "rb") as f:
                    while len(part := np.fromfile(f, np.int64, 3 * 65536)):
                        yield part.reshape(-1, 3)
                os.remove(self.files[b])
            yield from self.waiting.get(b, ())
        self.clear()


def sort_shard(batches: Iterator[pd.DataFrame], queue_bytes: int = QUEUE_BYTES, block: int = BLOCK) -> Iterator[pd.DataFrame]:
    """Contexts that arrive by name -> (row, from, to): spans of bytes to remove.

    The files live as long as the task and lie where Spark's own sorts of that executor spill; a lost task starts anew.
    """
    with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
        shard = Shard(folder, queue_bytes, block)
        for part in batches:
            for k in range(0, len(part), block):
                own = part.iloc[k : k + block]
                at = own["at"].to_numpy(np.int64)
                shard.add(own["bytes"].tolist(), at - own["first"].to_numpy(np.int64), own["name"].to_numpy(), own["row"].to_numpy(), at)
        yield from shard.spans()


def settled(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What names and context hashes decide, and what must be sorted: (spans, contexts).

    Names that occur once go. Names with one context are copies of it: all their windows repeat; so do all windows of a
    context that occurs twice. Of the different contexts of a name one row each is left, with their number.
    """
    own = [c for c in table.columns if c not in ("name", "context")]
    classes = table.groupBy("name").agg(F.count("*").alias("copies"), F.min("context").alias("a"), F.max("context").alias("b")).filter("copies > 1")
    classes = stored(classes.select("name", "copies", (F.col("a") != F.col("b")).alias("mixed")))
    live = stored(join_counted(table, classes, "name", "copies", table.count(), "inner"))
    whole = lambda df: df.select("row", F.col("first").alias("from"), (F.col("last") + SPAN).alias("to"))
    mixed = live.filter("mixed").drop("mixed")
    each = stored(mixed.groupBy("name", "context").agg(F.count("*").alias("copies"), F.min(F.struct(*own)).alias("one")))
    n_mixed, n_each = each.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    pair = F.struct("name", "context")
    twice = each.filter("copies > 1").select(pair.alias("pair"), "copies", F.lit(True).alias("again"))
    copied = join_counted(mixed.withColumn("pair", pair), twice, "pair", "copies", n_mixed, "inner")
    sizes = each.groupBy("name").agg(F.count("*").alias("contexts")).withColumn("n", F.col("contexts"))
    left = join_counted(each.select("name", "one.*"), sizes, "name", "n", n_each, "inner")
    return whole(live.filter(~F.col("mixed"))).union(whole(copied)), left


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The recursion: contexts of a name that has too many, under up to PARTS longer names each.

    A context's windows start `low` to `high` bytes before its anchor, and its name is the bytes that all of them cover.
    Windows of a part of that range cover more bytes together, and those are their name: contexts that differ there part.
    """
    for batch in batches:
        out = []
        for row, at, first, last, low, high, data in batch[["row", "at", "first", "last", "low", "high", "bytes"]].itertuples(index=False, name=None):
            width = -(-(high - low + 1) // PARTS)
            for a in range(low, high + 1, width):
                b = min(high, a + width - 1)
                near, far = max(a, at - last), min(b, at - first)
                if near <= far:
                    own = data[at - far - first : at - near - first + SPAN]
                    name = xxhash.xxh64_intdigest(data[at - a - first : at - b - first + SPAN], 1000 * a + b)
                    context = xxhash.xxh64_intdigest(own, 1000 * near + far)
                    out.append((row, at, at - far, at - near, a, b, name - (1 << 63), context - (1 << 63), own))
        yield pd.DataFrame(out, columns=["row", "at", "first", "last", "low", "high", "name", "context", "bytes"])


CONTEXT = "row long, at int, first int, last int, low int, high int"


def removed_spans(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(row, spans): the byte spans to remove from each numbered document (row, text); spans may overlap."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"].tolist(), batch["text"]):
                for at, first, last, name, context in anchors((text or "").encode("utf-8", "surrogatepass")):
                    yield pd.DataFrame({"row": row, "at": at, "first": first, "last": last, "name": name, "context": context})

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for part in find(batches):
            held.append(part)
            size += len(part)
            if size > 50_000:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    spans, left = settled(stored(docs.mapInPandas(gathered, "row long, at int, first int, last int, name long, context long")))
    by_row = left.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("name", "at", "first", "last", "contexts")).alias("wanted"))  # as many as a document has anchors

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text, wanted in zip(batch["row"].tolist(), batch["text"], batch["wanted"]):
                data = text.encode("utf-8", "surrogatepass")
                part = pd.DataFrame([dict(c) if not isinstance(c, dict) else c for c in wanted])
                part["row"], part["low"], part["high"] = row, 0, REACH
                part["bytes"] = [data[a : b + SPAN] for a, b in zip(part["first"].tolist(), part["last"].tolist())]
                yield part[["row", "at", "first", "last", "low", "high", "name", "contexts", "bytes"]]

    columns = ["row", "at", "first", "name", "bytes"]
    open_shards = stored(docs.join(by_row, F.col("row") == F.col("r")).select("row", "text", "wanted").mapInPandas(cut, f"{CONTEXT}, name long, contexts long, bytes binary"))
    shards = open_shards.filter(F.col("contexts") <= split).select(*columns)
    while not (crowded := open_shards.filter(F.col("contexts") > split)).isEmpty():
        more, open_shards = settled(stored(crowded.mapInPandas(parts, f"{CONTEXT}, name long, context long, bytes binary")))
        open_shards = stored(open_shards)
        spans = spans.union(more)
        shards = shards.union(open_shards.filter(F.col("contexts") <= split).select(*columns))
    # No name has more than `split` contexts any more, so no task's share is large.
    induced = shards.repartition("name").sortWithinPartitions("name").mapInPandas(sort_shard, "row long, from int, to int")
    return spans.union(induced).groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def merged(spans: list) -> list[list[int]]:
    """Sorted, disjoint and non-touching spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def deduplicated(docs: DataFrame, keep_bytes: bool = False, from_files: bool | None = None) -> DataFrame:
    """Per row of (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    Texts are UTF-8 bytes, null ones empty; a repeated row is elsewhere for its copies, so both go. Null and repeated
    ids are kept: rows are told apart by their place in the files that the table is read from, or that it is stored in
    first. An empty table gives an empty result. A text shorter than its spans fails the job.
    """
    numbered = with_row_ids(docs.select("doc_id", "text"), "row", from_files)
    spans = removed_spans(numbered.select("row", "text")).withColumnRenamed("row", "r")
    schema = "doc_id " + dict(docs.dtypes)["doc_id"] + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch["text"], batch["spans"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                gone, at, kept = merged(cuts) if cuts is not None else [], 0, []
                if gone and gone[-1][1] > len(data):
                    raise ValueError("a text has changed since its spans were found")
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), *([rest] if keep_bytes else [])))
            result = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")[1:]])
            result.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield result

    return numbered.join(spans, F.col("row") == F.col("r"), "left").select("doc_id", "text", "spans").mapInPandas(strip, schema)


def op5_induced_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in SQL: every window of every text, counted; runs of repeated windows are the spans.
ORACLE_OP5 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - {SPAN - 1})) AS i, h FROM d WHERE n >= {SPAN}),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * SPAN})) AS m FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {SPAN} THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + {SPAN} AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM s),
p AS (
  SELECT e.doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept, max(b) AS last
  FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""
