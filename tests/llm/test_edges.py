"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

from sheetwise.llm import chat_format, decontaminate, filter_audit, mixing, packing, periodic, pii, quality_rules, sharding, simhash, suffix_dedup, toxicity, warc

LONG = "alpha beta gamma delta " * 30_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 10, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 10, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a", 10, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, ""),
    (5, " \t\n", "en", "b", 3, "y"),
    (6, LONG, "en", "a", len(LONG), "y"),
    (None, "no id here but some words to read", "en", "c", 5, None),
    (None, None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
CLASHES = ("shard", "slot", "fp", "row", "score", "block", "component_id", "spans", "_part", "_row", "name", "c0")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.selectExpr("*", *[f"'own' as {c}" for c in CLASHES]).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


def test_pii(docs, empty):
    got = pii.find_private(docs)
    assert got.count() == len(ROWS) and pii.find_private(empty).count() == 0
    assert pii.sanitise(docs).columns == docs.columns and {r["name"] for r in pii.sanitise(docs).collect()} == {"own"}


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog and runs"), (8, None), (9, ""), (9, "hi")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contaminations(docs, items).collect()]
    assert sorted(got) == [(1, 7, 1.0), (2, 7, 1.0), (2, 7, 1.0)]
    assert decontaminate.contaminations(empty, items).count() == 0 and decontaminate.contaminations(docs, items.filter("false")).count() == 0
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_shards(docs, empty):
    got = sharding.shard_plan(docs).collect()
    assert len(got) == len(ROWS) and sharding.shard_plan(empty).count() == 0
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (3, 4)} == {(1, 0)}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a\r\nX: y", "é" * 60), (2, None, "é" * 60), (2, None, "é" * 60), (3, "u", None), (4, "u", ""), (None, "u", "é" * 60)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = [(r["type"], r["record_id"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()]
    page = warc.ID
    assert sorted(got, key=str) == sorted([("response", page + "1", None, 120), ("revisit", page + "2", page + "1", 120), ("revisit", page + "2", page + "1", 120), ("response", page + "3", None, 0), ("response", page + "4", None, 0), ("revisit", page + "null", page + "1", 120)], key=str)
    clashing = pages.selectExpr("*", "'own' as digest", "'own' as value", "'own' as size", "'own' as first", "0L as bytes")
    warc.write_archives(clashing, str(tmp_path / "c"))
    assert sorted((r["type"], r["record_id"]) for r in warc.read_archives(spark, str(tmp_path / "c")).collect()) == sorted((t, i) for t, i, *_ in got)
    warc.write_archives(pages.filter("false"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_suffixes(docs, empty):
    got = {}
    for r in suffix_dedup.deduplicated(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    assert got[6] == [(len(LONG), len(LONG), 1)]  # every long string recurs a few words on
    assert sorted(got[None]) == [(0, 0, 0), (33, 0, 0)] and got[3] == got[4] == [(0, 0, 0)]
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_toxicity(spark, docs, empty):
    model = toxicity.train(docs, labels(spark))
    assert all(0 <= s <= 1 for s in model.scores([r[1] for r in ROWS]))
    assert toxicity.train(empty, labels(spark)).scores([None, "x"]).tolist() == pytest.approx([0.25, 0.25])


def test_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<a> & </turn>"), (1, 1, "assistant", "<a> & </turn>"), (1, 2, None, "x"), (None, None, "system", ""), (2, 0, "user", "only &amp; user")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", ""), ("assistant", "<a> & </turn>"), ("assistant", "<a> & </turn>"), ("", "x")]
    assert back[1]["loss"] == "<a> & </turn>" * 2 and back[2]["loss"] == "" and back[2]["turns"][0]["text"] == "only &amp; user"
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("system", "")]
    assert chat_format.format_chats(turns.filter("false")).count() == 0
    clashing = turns.selectExpr("*", "'own' as turns", "'own' as formatted", "'own' as target", "'own' as t")
    assert chat_format.format_chats(clashing).count() == chat_format.format_chats(turns).count()


def test_quality(spark, docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels(spark)).collect()}
    assert got[3]["n_words"] == 0 and not got[3]["kept"] and got[6]["n_words"] == 120_000 and got[6]["n_repeat_words"] == 120_000
    assert quality_rules.judge(empty, labels(spark)).count() == 0 and quality_rules.judge(docs, labels(spark).filter("false")).count() == len(ROWS)


def test_simhash(spark, docs, empty):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_groups(docs).collect()]
    assert len(got) == len(ROWS) and {c for d, _, c in got if d in (1, 2)} == {1}
    assert {c for d, f, c in got if f == 0} == {3}
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.stage_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "6", "None"]
    assert {r["_row"] for r in kept.collect()} == {"own"} and simhash.stage_near_dedup(spark, empty, "").count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, block_rows=1)
    assert got.count() == len(ROWS) and {r["c0"] for r in got.collect()} == {"own"}
    assert mixing.mix(empty).count() == 0
    mixed = mixing.stage_mix(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() == len(ROWS) and {r["slot"] for r in mixed.collect()} == {"own"}
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1.0})


def test_pipeline_stages(spark, docs, empty, tmp_path):
    """Each stage on odd rows and on none: columns stay, rows go only where the stage says so."""
    sharded = sharding.stage_shards(spark, docs, "")
    assert sharded.count() == len(ROWS) and set(sharded.columns) == {*docs.columns, *sharding.PLAN}
    assert {r["component_id"] for r in sharded.collect()} == {"own"} and sharding.stage_shards(spark, empty, "").count() == 0
    folder = str(tmp_path)
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog and runs"), (8, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    clean = decontaminate.stage_decontaminate(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3 and decontaminate.stage_decontaminate(spark, empty, folder).count() == 0
    kept = toxicity.stage_toxicity(spark, docs, folder)
    assert kept.columns == docs.columns and toxicity.stage_toxicity(spark, empty, folder).count() == 0


def test_pipeline_of_odd_rows(spark, docs, empty, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, table in (("odd", docs), ("none", empty)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels(spark).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog and runs")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = pipeline.run(spark, folder)
        assert {"text", "shard", "slot"} <= set(out.columns) and (out.count() > 0) == (name == "odd")


def test_packing(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.packed(docs, path).collect()
    assert packing.packed(empty, path).count() == 0
    firsts = [r for r in got if r["start"] == 0]
    assert len(firsts) == len(ROWS) and sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in firsts)
    assert {r["doc_tokens"] for r in firsts if r["doc_id"] in (3, 4)} == {1} and max(r["doc_tokens"] for r in firsts) > packing.STRETCH


def test_audit(spark, docs, empty):
    from pyspark.sql import functions as F

    assert filter_audit.audit(empty, labels(spark)).count() == 0
    got = filter_audit.audit(docs, labels(spark))
    assert {r["part"] for r in got.collect()} == {"", "en"} and got.count() == 2 * 600
    last = got.filter("step = 5").groupBy("part").agg(F.min("kept").alias("a"), F.max("kept").alias("b")).collect()
    assert all(r["a"] == r["b"] == 0 for r in last)


def test_periodic(docs, empty):
    from pyspark.sql import functions as F

    got = docs.select("doc_id", periodic.periodic_runs(F.col("text")).alias("r")).collect()
    assert len(got) == len(ROWS) and empty.select(periodic.periodic_runs(F.col("text"))).count() == 0
    runs = {r["doc_id"]: [tuple(x) for x in r["r"]["runs"]] for r in got}
    assert runs[6] == [(0, 120_000, 4)] and not any(v for k, v in runs.items() if k != 6)
    assert {r["r"]["collapsed"] for r in got if r["doc_id"] in (3, 4, 5)} == {""}
