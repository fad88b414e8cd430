"""Results that must not depend on how a scan is dealt out, on hubs, on alphabets or on the number of blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import common, decontaminate, mixing, simhash, suffix_dedup, toxicity

PARTS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def dealt(spark):
    """The same files in `n` partitions at least from now on."""

    def deal(n):
        spark.conf.set(PARTS, str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << (22 if n < 5 else 10)))

    yield deal
    spark.conf.unset(PARTS)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many") / "t")
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(9).write.parquet(path)
    return path


def test_row_ids_stay(spark, dealt, files):
    docs = spark.read.parquet(files).select("doc_id")
    numbered = common.with_row_ids(docs, "row")
    seen = []
    for n in (2, 9):
        dealt(n)
        seen.append({r["doc_id"]: r["row"] for r in numbered.collect()})
    assert seen[0] == seen[1] and len(set(seen[0].values())) == docs.count()
    derived = common.with_row_ids(docs.union(docs), "row")
    assert derived.select("row").distinct().count() == 2 * docs.count()
    with pytest.raises(Exception, match="(?i)metadata|resolve"):
        common.with_row_ids(docs.union(docs), "row", from_files=True).collect()


def test_deduplicated_in_another_scan(spark, dealt, files):
    dealt(4)
    docs = spark.read.parquet(files)
    plan = suffix_dedup.deduplicated(docs)
    usual = {r["doc_id"]: tuple(r) for r in suffix_dedup.deduplicated(spark.read.parquet(files)).collect()}
    dealt(9)
    assert {r["doc_id"]: tuple(r) for r in plan.collect()} == usual and sum(r[2] for r in usual.values()) > 0


def test_stages_in_another_scan(spark, dealt, files):
    for stage in (simhash.stage_near_dedup, mixing.stage_mix):
        dealt(4)
        docs = spark.read.parquet(files)
        plan = stage(spark, docs, "")
        usual = sorted(r["doc_id"] for r in stage(spark, spark.read.parquet(files), "").select("doc_id").collect())
        dealt(9)
        assert sorted(r["doc_id"] for r in plan.select("doc_id").collect()) == usual


def test_components_of_stars_and_chains(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = simhash.components(star)
    assert got.count() == 100_000 and got.filter("root <> 0").isEmpty()
    rng = random.Random(1)
    names = rng.sample(range(10**6), 3000)
    chain = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])] + [(10**7 + k, 10**7 + k + 1) for k in range(0, 60, 2)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {n: min(names) for n in names if n != min(names)} | {10**7 + k + 1: 10**7 + k for k in range(0, 60, 2)}


def test_any_alphabet():
    """Landmarks of 85 and more different characters match themselves, and what the screen leaves out is below the cut."""
    rng = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(120)]
    marks = ["\x02" + "".join(rng.sample(letters, rng.randint(5, 18))) + "\x03" for _ in range(40)]
    words = marks + [m[:4] + rng.choice(letters) + m[4:-2] + "\x03" for m in marks] + ["\x02" + "".join(rng.sample(letters, 8)) + "\x03" for _ in range(100)]
    words = [w[: toxicity.LONGEST] for w in words]
    table = toxicity.Marks(marks)
    like = table.similar(words)
    assert np.allclose(np.diag(like[:40]), 1, atol=1e-4)
    rows = toxicity.codes(words)
    own = np.array([toxicity.kernel(rows[k : k + 1], rows[k : k + 1])[0] for k in range(len(rows))])
    for j in range(40):
        plain = toxicity.kernel(rows, table.rows[j : j + 1]) / np.sqrt(own * table.norm[j])
        assert np.allclose(like[:, j], np.where(plain >= toxicity.CUT, plain, 0), atol=1e-4)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    usual = sorted(map(tuple, decontaminate.contaminations(docs, items).select("doc_id", "item_id", "score").collect()))
    kept = sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", max(2, items.count() // 3))
    assert sorted(map(tuple, decontaminate.contaminations(docs, items).select("doc_id", "item_id", "score").collect())) == usual
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs.union(docs.limit(0)), items).collect()) == kept == sorted({r["doc_id"] for r in docs.collect()} - {d for d, _, _ in usual})


def test_code_points_of_letters_that_lengthen(spark):
    item = "rare quick brown foxes jump over lazy dogs near istanbul harbour tonight"
    text = "İİ İzmir says: " + item.replace("istanbul", "istanbul").upper().replace("I", "I") + " and so on"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontaminate.contaminations(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert text[got["char_start"] : got["char_end"]].lower() == item


def test_every_link_of_a_meeting(spark):
    """Texts that all meet, as all their samples come from a passage they share, but are near copies by twos only."""
    rng = random.Random(5)
    name = lambda: f"w{rng.randrange(10**9)}"
    shared = [name() for _ in range(90)]
    samples = simhash.sketch(" ".join(shared), 5)[0][1:]
    texts = []
    while len(texts) < 60:
        tail = [name() for _ in range(13)]
        both = [" ".join(shared + t) for t in (tail, tail[:-2] + [name(), name()])]
        if simhash.sketch(both[0], 5)[0][1:] == samples == simhash.sketch(both[1], 5)[0][1:]:
            texts += both
    least = [simhash.sketch(t, 5)[1] for t in texts]
    twos = {(a, b) for a in range(len(texts)) for b in range(a) if simhash.jaccard(least[a], least[b]) >= 0.8}
    assert twos == {(k + 1, k) for k in range(0, len(texts), 2)}
    texts += [texts[7], texts[7], texts[0] + " and more words at its end than any copy has, so that it is like none of them by far, not even by half of its words " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    wanted = {(a, b) for a, b in twos} | {(60, 6), (61, 6)}
    for block in (512, 7):
        found = {(r["node"], r["root"]) for r in simhash.near_texts(docs, block=block).collect()}
        assert found == wanted


def test_links_of_blocks(monkeypatch):
    """No link is left out, whether lists are whole or cut."""
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rng = np.random.default_rng(3)
    least, labels = [], list(range(120))
    for k in range(120):
        own = np.sort(rng.choice(1 << 40, int(rng.choice([1, 4, 9, 40, 104, 126, 140])), replace=False)) if k % 4 == 0 else np.sort(np.append(own[rng.random(len(own)) > 0.06], rng.choice(1 << 40, 1 + len(own) // 30)))
        least.append(own[: simhash.LEAST_HASHES].astype(np.int64))
    wanted = {(a, b) for a in labels for b in labels[:a] if simhash.jaccard(least[a], least[b]) >= 0.8}
    near = {k: k for k in labels}
    for links in (wanted, found := simhash.linked_texts(labels, labels, least, 0.8)):
        near = {k: k for k in labels}
        for _ in labels:
            for a, b in links:
                near[a] = near[b] = min(near[a], near[b])
        wanted_groups = near if links is wanted else wanted_groups
    assert near == wanted_groups and set(found) <= wanted and len(wanted) > 20


def test_trees_of_landmarks():
    """Strings compared by a tree of their beginnings have the kernel that each has alone; a lower bound of own kernels holds."""
    marks = ["\x02pathe", "\x02pathetic\x03", "\x02patheti", "\x02loser\x03", "\x02lose", "\x02aaaa\x03"]
    words = ["\x02pathetik\x03", "\x02p4thetic\x03", "\x02looser\x03", "\x02aaaaaaaa\x03", "\x02zzzz\x03"]
    a, alone = toxicity.codes(words), toxicity.codes(marks)
    for own, nodes, letters, parents in toxicity.trees(marks):
        got = toxicity.tree_kernel(a, letters, parents, chunk=2)[:, nodes]
        assert got == pytest.approx(np.stack([toxicity.kernel(a, alone[j : j + 1]) for j in own], axis=1), rel=1e-5)
    least = toxicity.Marks(marks).least[(a != toxicity.PAD).sum(axis=1)]
    assert (least <= 1.0001 * toxicity.kernel(a, a)).all()


def test_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, wanted in (("10000", "1000"), ("0", "1000"), ("30", "30")):
            spark.conf.set(key, given)
            common.small_batches(spark)
            assert spark.conf.get(key) == wanted
    finally:
        spark.conf.set(key, before)


def test_remembered_features_hold_their_own_memory():
    model = toxicity.Model(["\x02idiot\x03", "\x02moron\x03"], np.zeros(2), 0.0, np.zeros(toxicity.TOP + 1), 0.0)
    known = model.features({b"idiot", b"idiots", b"a/moron", b"moron-idiot", *(b"word%d" % k for k in range(2000))})
    rows = [v for v in known.values() if v is not None]
    assert {b"idiot", b"idiots", b"a/moron"} <= {t for t, v in known.items() if v is not None} and all(v.base is None and v.nbytes == 8 for v in rows)  # a view keeps the batch that it is of
