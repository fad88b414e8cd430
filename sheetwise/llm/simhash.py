"""Operator 9: SimHash near-duplicates found by vantage-point trees.

Texts become 64-bit fingerprints. A vantage-point tree, fitted on a bounded sample, cuts the Hamming space into
shards: at each node the fingerprints within the node's radius of its vantage point go inside and the others outside.
If two fingerprints differ in at most `bits` places, their distances to any vantage point differ by no more than that
(triangle bound), so those just inside the radius are handed to the outer shard too; each linked pair then meets in
a shard. A shard that is still large is cut further by local trees of the same kind, and compared exactly.

Copies share one fingerprint, so a group of any size is one point here; shards emit a spanning forest, never all pairs.

Texts whose word shingles have a Jaccard similarity of 0.8 differ in about ten bits, and no tree prunes at that radius.
`near_texts` therefore gives a text several fingerprints: the SimHash of all its shingles, and those of small samples of
them (the least by a hash, so that like texts draw like samples, often the very same). All go through the same tree;
texts that meet by any are then held against each other by the shingles themselves: first against two of those they
meet, then, where that doesn't make them one group, all against all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import ROW, join_counted, stored, with_row_ids

#: Fingerprints that the shard tree is fitted on, at most: 0.8 MB in the driver at any corpus size.
SAMPLE = 100_000
#: Fingerprints a shard is meant to hold, and shards that the fitted tree has at most (it is sent to every task: 4 numbers
#: a node). More are made below its leaves by vantage points that follow from the shard's number.
SHARD_SIZE, FITTED_SHARDS = 2048, 1 << 14
#: Samples of a text's shingles, shingles of a sample, and least shingle hashes that similarity is computed from.
SAMPLES, SAMPLE_SHINGLES, LEAST_HASHES = 8, 4, 128
#: Texts of a block: texts that meet are compared all with all by two blocks at a time.
MEETING = 512
#: Hashes whose owners are counted at once there.
COLUMNS = 2048
#: A local shard up to this size is compared directly.
DIRECT = 4096
#: Vantage points tried at each node.
TRIALS = 8

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; a text of fewer words is one shingle, one without words none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """SimHash: a bit is 1 if it is set in over half the hashes; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: str | None, shingle: int) -> tuple[list[int], list[int]]:
    """(fingerprints of a text and of its samples, its least shingle hashes), as signed numbers."""
    hashes = shingle_hashes(text, shingle)
    prints, kinds = [majority(hashes)], np.unique(hashes)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES if len(kinds) else 0):
            turned = scramble(kinds + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1))
            few = turned if len(turned) <= SAMPLE_SHINGLES else np.partition(turned, SAMPLE_SHINGLES - 1)[:SAMPLE_SHINGLES]
            prints.append(majority(few))
        least = np.sort(scramble(kinds))[:LEAST_HASHES]
    return np.array(prints, np.uint64).view(np.int64).tolist(), least.view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two texts from their least shingle hashes: exact up to LEAST_HASHES shingles, then from as large a sample."""
    a, b = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
    both = np.union1d(a, b)
    if len(a) >= LEAST_HASHES or len(b) >= LEAST_HASHES:
        both = both[: min(len(x) for x in (a, b, both) if len(x) >= LEAST_HASHES)]
    return float((np.isin(both, a, True) & np.isin(both, b, True)).mean()) if len(both) else 1.0


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def split_at(points: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """Vantage point and radius for these points: least points on the larger side, copies over the edge included."""
    best = None
    for vantage in rng.choice(points, min(TRIALS, len(points)), replace=False):
        near = np.bincount(np.bitwise_count(points ^ vantage), minlength=65).cumsum()
        inner = near[:-1]
        outer = len(points) - np.concatenate([np.zeros(bits, np.int64), near[:-1]])[: len(inner)]  # outside takes distances over radius - bits
        larger = np.maximum(inner, outer)
        radius = int(larger.argmin())
        if larger[radius] < 0.9 * len(points) and (best is None or larger[radius] < best[0]):
            best = (int(larger[radius]), int(vantage), radius)
    return best and best[1:]


def grow(points: np.ndarray, shards: int, bits: int, seed: int = 9) -> list[tuple[int, int, int, int]]:
    """Tree as nodes (vantage, radius, inner node, outer node); a negative number -k - 1 is shard k."""
    rng, nodes, made = np.random.default_rng(seed), [], 0

    def build(own: np.ndarray, wanted: float) -> int:
        nonlocal made
        cut = split_at(own, bits, rng) if wanted > 1 and len(own) >= 16 else None
        if cut is None:
            made += 1
            return -made
        here = len(nodes)
        nodes.append((0, 0, 0, 0))
        d = np.bitwise_count(own ^ np.uint64(cut[0]))
        sides = [build(own[d <= cut[1]], wanted / 2), build(own[d > cut[1] - bits], wanted / 2)]
        nodes[here] = (*cut, *sides)
        return here

    build(points, shards)
    return nodes


def deeper(points: np.ndarray, index: np.ndarray, shard: np.ndarray, bits: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards cut in two `levels` times: the vantage point of each is a hash of its number, its radius half the bits."""
    for _ in range(levels):
        with np.errstate(over="ignore"):
            vantage = scramble((shard.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        d = np.bitwise_count(points[index] ^ vantage)
        inner, outer = d <= 31, d > 31 - bits
        index, shard = np.concatenate([index[inner], index[outer]]), np.concatenate([2 * shard[inner] + 1, 2 * shard[outer] + 2])
    return index, shard


def shards_of(points: np.ndarray, nodes: list[tuple[int, int, int, int]], bits: int, levels: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, shard) for all shards that each point belongs to, `levels` below the fitted tree."""
    if not nodes:
        return deeper(points, np.arange(len(points)), np.zeros(len(points), np.int64), bits, levels)
    index, shard, work = [], [], [(0, np.arange(len(points)))]
    while work:
        node, own = work.pop()
        if not len(own):
            continue
        if node < 0:
            index.append(own)
            shard.append(np.full(len(own), -node - 1))
            continue
        vantage, radius, inner, outer = nodes[node]
        d = np.bitwise_count(points[own] ^ np.uint64(vantage))
        work += [(inner, own[d <= radius]), (outer, own[d > radius - bits])]
    return deeper(points, np.concatenate(index), np.concatenate(shard), bits, levels) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def join_directly(points: np.ndarray, bits: int, parent: np.ndarray, own: np.ndarray) -> None:
    """Join the components of all points of `own` that are linked; each point is held against all others once."""
    mine = points[own]
    close = np.zeros((len(own), len(own)), bool)
    for at in range(0, len(own), 256):
        close[at : at + 256] = np.bitwise_count(mine[at : at + 256, None] ^ mine[None, :]) <= bits
    left = close.sum(axis=1) > 1
    for k in range(len(own)):
        if left[k]:
            found, edge = np.zeros(len(own), bool), np.array([k])
            while len(edge):
                found[edge], left[edge] = True, False
                edge = np.flatnonzero(close[edge].any(axis=0) & ~found)
            members = own[np.flatnonzero(found)].tolist()
            for other in members[1:]:
                a, b = root(parent, members[0]), root(parent, other)
                parent[max(a, b)] = min(a, b)


def root(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = int(parent[k])
    return k


def forest(points: np.ndarray, bits: int) -> np.ndarray:
    """Label of each point: the index of the first point of its component within this shard."""
    parent, rng = np.arange(len(points)), np.random.default_rng(len(points))
    work = [np.arange(len(points))]
    while work:
        own = work.pop()
        cut = split_at(points[own], bits, rng) if len(own) > DIRECT else None
        if cut is None:
            for at in range(0, len(own), DIRECT):  # a crowd that no vantage point cuts, block by block
                for after in range(at, len(own), DIRECT):
                    join_directly(points, bits, parent, own[at : at + DIRECT] if at == after else np.concatenate([own[at : at + DIRECT], own[after : after + DIRECT]]))
            continue
        d = np.bitwise_count(points[own] ^ np.uint64(cut[0]))
        work += [own[d <= cut[1]], own[d > cut[1] - bits]]
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def links(prints: DataFrame, n: int, bits: int = 2, fitted: int = FITTED_SHARDS, size: int = SHARD_SIZE) -> DataFrame:
    """Forest edges (a, b), b < a, over distinct fingerprints (column `fp`, `n` of them): its components are exact."""
    spark, wanted = prints.sparkSession, -(-n // size)
    sample = np.array([r[0] for r in prints.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    # At most as many nodes of four numbers as shards are fitted, so sending the tree is bounded.
    tree, levels = spark.sparkContext.broadcast(grow(sample, min(wanted, fitted), bits)), max(0, (-(-wanted // fitted) - 1).bit_length())

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            index, shard = shards_of(batch["fp"].to_numpy(np.int64).view(np.uint64), tree.value, bits, levels)
            yield pd.DataFrame({"shard": shard, "fp": batch["fp"].to_numpy()[index]})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(group["fp"].to_numpy(np.int64))
        label = forest(points.view(np.uint64), bits)
        member = np.flatnonzero(label != np.arange(len(points)))
        return pd.DataFrame({"a": points[member], "b": points[label[member]]})

    dealt = prints.select("fp").mapInPandas(route, "shard long, fp long")
    return dealt.groupBy("shard").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b): alternating large and small stars until nothing changes.

    Each round is a few shuffles of narrow rows; edges are stored between rounds and never gathered. A node that a great
    part of all edges meet is looked up in a broadcast of bounded size, so no task holds its edges.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    while True:
        both = edges.union(edges.select("b", "a"))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("size")))
        large = stored(join_counted(both, low, "a", "size", 2 * n, "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size")))
        small = join_counted(large, low, "a", "size", large.count(), "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        fresh = stored(small.filter("a <> b").distinct())
        if fresh.count() == n and fresh.join(edges, ["a", "b"], "left_anti").isEmpty():
            return fresh.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, n = fresh, fresh.count()


def near_groups(docs: DataFrame, bits: int = 2, shingle: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) of every row: the smallest key reachable over links of at most `bits` bits.

    Null and empty texts have fingerprint 0, as any other; repeated rows are all returned; null keys never name
    a component unless it has no other. Only key and text are read. An empty table gives an empty result.
    """
    prints = stored(docs.select(key, fingerprint_column(F.col("text"), shingle).alias("fp")))
    groups = stored(prints.groupBy("fp").agg(F.count("*").alias("copies"), F.min(key).alias("first")))
    total, distinct = groups.agg(F.sum("copies"), F.count("*")).first()
    roots = components(links(groups, distinct, bits))
    linked = groups.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, F.col("root") == F.col("r")).select("fp", "copies", "component_id")
    return join_counted(prints, named, "fp", "copies", total or 0, "inner")


def linked_texts(rows: list[int], labels: list[int], least: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different labels, as many as connect them: all that `jaccard` tells, none is left out."""
    size, (kinds, label) = np.array([len(x) for x in least]), np.unique(labels, return_inverse=True)
    _, code, times = np.unique(np.concatenate([np.zeros(0, np.int64), *least]), return_inverse=True, return_counts=True)
    owner, again = np.repeat(np.arange(len(least)), size), np.cumsum(times > 1) - 1
    owner, code = owner[times[code] > 1], again[code[times[code] > 1]]
    common = np.zeros((len(least), len(least)), np.float32)
    for k in range(0, int(code.max(initial=-1)) + 1, COLUMNS):  # hashes that several texts have, so many at once
        here = (code >= k) & (code < k + COLUMNS)
        held = np.zeros((len(least), COLUMNS), np.float32)
        held[owner[here], code[here] - k] = 1
        common += held @ held.T
    # Whole lists tell by their numbers; cut ones have this share of the longer one in common, or more, if they are linked.
    longer, whole = np.maximum(size[:, None], size[None, :]), np.maximum(size[:, None] + size[None, :] - common, 1)
    reach = np.where(longer < LEAST_HASHES, common >= (similarity - 1e-9) * whole, common >= similarity * longer - 1e-6)
    may = np.tril(reach & (label[:, None] != label[None, :]))
    parent, own, found = list(range(len(kinds))), label.tolist(), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(may))):
        a, b = root(parent, own[i]), root(parent, own[j])
        if a != b and jaccard(least[i], least[j]) >= similarity:
            found.append((rows[i], rows[j]))
            parent[max(a, b)] = min(a, b)
    return found


def left_links(meetings: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, block: int = MEETING) -> DataFrame:
    """Links (a, b) that are still missing between texts (row, least) that meet (meet, row): every two are held against each other.

    `roots` has the groups found so far. Meetings within one group are done. The texts of a larger meeting are dealt into
    blocks by a hash, and every two blocks are compared by a task of their own, so no task holds more than two blocks.
    """
    named = stored(meetings.join(roots, F.col("row") == F.col("node"), "left").select("meet", "row", F.coalesce("root", "row").alias("label")))
    unlike = named.groupBy("meet").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    unlike = unlike.select("meet", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = stored(join_counted(named, stored(unlike), "meet", "n", named.count(), "inner"))
    own, other = F.pmod(F.xxhash64("row", "meet"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.select("meet", "row", "label", own.alias("own"), other.alias("other"))
    pairs = dealt.select("meet", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), F.col("row").alias("r"), "label")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = linked_texts(group["r"].tolist(), group["label"].tolist(), group["least"].tolist(), similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.join(texts, F.col("r") == F.col("row")).select("meet", "one", "two", "r", "label", "least").groupBy("meet", "one", "two").applyInPandas(compare, "a long, b long")


def near_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 2, block: int = MEETING) -> DataFrame:
    """(node, root) of every row (row, text) that has a near copy: equal roots are one group, others are left out.

    Near copies are texts whose sets of `words`-word shingles have at least that Jaccard similarity, and what such texts
    connect. They are searched by the fingerprints of their samples: two texts at the similarity 0.8 draw an equal sample
    of four with a chance of 0.4, so one in eight with 0.98. Texts with the same least hashes are one, with copies. Texts
    that meet are first each held against two of theirs, chosen by a hash, which connects most; where a meeting isn't one
    group then, all its texts are held against all (`left_links`), so every link between texts that meet counts. Null and
    empty texts are near copies of each other; an empty table gives none.
    """

    @F.pandas_udf("struct<prints:array<bigint>,least:array<bigint>>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sketch(t, words) for t in texts], columns=["prints", "least"])

    @F.pandas_udf("double")
    def likeness(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([jaccard(a, b) for a, b in zip(left, right)], dtype="float64")

    every = stored(docs.select("row", sketches("text").alias("s")).select("row", "s.*", F.concat_ws(":", F.xxhash64("s.least"), F.hash("s.least")).alias("kind")))
    classes = stored(every.groupBy("kind").agg(F.count("*").alias("copies"), F.min("row").alias("first")))
    copied = stored(join_counted(every.select("row", "kind"), classes.filter("copies > 1"), "kind", "copies", every.count(), "inner").select("row", "first"))
    table = stored(every.join(copied.filter("row <> first").select(F.col("row").alias("copy")), F.col("row") == F.col("copy"), "left_anti").select("row", "prints", "least"))
    each = table.select("row", F.explode(F.array_distinct("prints")).alias("fp"))
    turn = F.struct(F.xxhash64("row", "fp"), F.col("row"))
    groups = stored(each.groupBy("fp").agg(F.count("*").alias("copies"), F.min(turn).alias("low"), F.max(turn).alias("high")))
    total, distinct = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    roots = components(links(groups, distinct, bits))
    linked = groups.join(roots, F.col("fp") == F.col("node"), "left").withColumn("meet", F.coalesce("root", "fp"))
    met = linked.groupBy("meet").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter(F.col("low") != F.col("high")).withColumnRenamed("meet", "m")
    homes = stored(linked.join(met, F.col("meet") == F.col("m")).select("fp", "copies", "meet", F.array(met["low.row"], met["high.row"]).alias("others")))
    # Each row meets at most two others by each of its fingerprints here.
    meetings = stored(join_counted(each, homes, "fp", "copies", total, "inner").select("row", "meet", "others"))
    offers = meetings.select("row", F.explode("others").alias("other")).filter("row <> other").distinct()
    own = stored(offers.join(table.select("row", "least"), "row"))
    sizes = own.groupBy("other").agg(F.count("*").alias("n"))
    partners = sizes.join(table.select(F.col("row").alias("other"), F.col("least").alias("theirs")), "other")
    pairs = join_counted(own, partners, "other", "n", own.count(), "inner")
    first = components(pairs.filter(likeness("least", "theirs") >= similarity).select(F.col("row").alias("a"), F.col("other").alias("b")))
    rest = stored(left_links(meetings.select("meet", "row").distinct(), table.select("row", "least"), first, similarity, block))
    found = first if rest.isEmpty() else components(rest.union(first))
    # A copy has the group of the first of its class.
    copies = copied.filter("row <> first").join(found, F.col("first") == F.col("node"), "left").select(F.col("row").alias("node"), F.coalesce("root", "first").alias("root"))
    return found.union(copies)


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies, the row with the smallest doc_id stays (one row of repeated ones).

    Near copies share five-word shingles to a similarity of 0.8 or more; null and empty texts are one group. Null ids
    come last. Rows are told apart by their place in the files that `docs` is read from, or is stored in first. The columns are those of `docs`, whatever their
    names, and an empty table stays empty.
    """
    numbered = with_row_ids(docs)
    found = near_texts(numbered.select(F.col(ROW).alias("row"), "text"))
    members = stored(found.union(found.select("root", "root").distinct()))
    known = members.join(numbered.select(F.col(ROW).alias("node"), F.col("doc_id").alias("id")), "node")
    first = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))).alias("kept"))
    gone = members.join(first, "root").filter(F.col("node") != F.col("kept.node")).select(F.col("node").alias("_gone"))
    return numbered.join(gone, F.col(ROW) == F.col("_gone"), "left_anti").select(*docs.columns)
