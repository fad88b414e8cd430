"""Rows as the sheets, the preview and Markdown show them: pure projections of compared rows, sections and paragraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.text import cut_cell, interface_mode, limit_text, normalize_opcode, related_interface, section_label, shown, strip_dummy_notes
from sheetwise.operators.compare import STATUS_LABELS, change_text

#: Labels, notes and columns of the sheets (fixed texts).
COMMAND_FIELDS = {"address": "Address", "dummy": "Dummy", "data": "Data", "extra": "其他欄位"}
COMMAND_HEADERS = ("比較結果", "變更說明（舊 → 新）", "介面模式", "指令名稱", "Opcode", "設定", "Address", "Dummy", "Data", "其他欄位", "分組", "章節", "新版頁碼", "舊版頁碼")
COMMAND_NOTES = {
    "added": "新版新增，舊版無對應指令。",
    "removed": "舊版有此指令，新版已移除；本列內容為舊版。",
    "review": "相同 介面模式／指令名稱／Opcode／設定 出現多筆，未自動配對，請人工核對。",
}
COMPARE_HEADERS = (
    "比較結果", "變更欄位", "變更說明（舊 → 新）", "產品名稱", "Opcode", "unit", "max", "typ", "min", "symbol", "SPI/QPI", "3/4 byte address", "Dummy", "Starting Address",
    "spec type", "相關指令", "parameter", "condition", "description", "新版頁碼", "舊版頁碼")
SPEC_NOTES = {
    "added": "新版新增，舊版無對應規格。",
    "removed": "舊版有此規格，新版已移除；本列數值為舊版內容。",
    "review": "相同產品／規格類型／symbol／parameter／condition 出現多筆，未自動配對，請人工核對。",
}
TEXT_STATUS_LABELS = {"same": "相同", "part": "僅型號替換", "changed": "修改", "added": "新增", "removed": "移除"}
TITLE_MARK, OLD_PREFIX = "〔章節標題〕", "舊版 / "
#: Characters that the runs of a cell hold, and what says that some are missing.
CELL, CUT_MARK = 32_000, "…（已截斷）"


def labelled(status: Column, labels: dict[str, str]) -> Column:
    """The display label of a status; empty for an unknown one."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[status], F.lit(""))


def command_rows(commands: DataFrame) -> DataFrame:
    """The 14 columns of the instruction sheet; a removed instruction has its page among the old ones."""
    status, removed = F.col("status"), F.col("status") == "removed"
    names = F.create_map(*[F.lit(x) for pair in COMMAND_FIELDS.items() for x in pair])
    renamed = F.transform("changes", lambda x: F.struct(F.coalesce(names[x["field"]], x["field"]).alias("field"), x["old"].alias("old"), x["new"].alias("new")))
    note = F.when(status == "changed", change_text(renamed)).otherwise(labelled(status, COMMAND_NOTES))
    page = F.col("page").cast("string")
    values = (labelled(status, STATUS_LABELS), note, F.col("mode"), F.col("command"), normalize_opcode(F.col("opcode")), F.col("setting"), F.col("address"), strip_dummy_notes(F.col("dummy")),
              F.col("data"), F.col("extra"), F.col("group"), F.col("section"), F.when(removed, "").otherwise(page), F.when(removed, page).otherwise(F.col("old_page")))
    return commands.select(*[v.alias(c) for v, c in zip(values, COMMAND_HEADERS)])


def named_opcodes(commands: Column) -> tuple[Column, Column]:
    """(codes joined by slashes, names joined) of a list `02h Page Program；20h/21h Sector Erase`, footnotes left out."""
    code = r"(?i)^\s*((?:[0-9a-f]{2}h)(?:\s*[/,]\s*[0-9a-f]{2}h)*)\s*"
    entries = F.transform(F.split(F.coalesce(commands, F.lit("")), "[；;]"), lambda e: F.regexp_replace(e, r"(?i)([0-9a-f]{2}h)\s*\(\s*\d+(?:\s*,\s*\d+)*\s*\)", "$1"))
    found = F.flatten(F.transform(entries, lambda e: F.regexp_extract_all(F.regexp_extract(e, code, 1), F.lit("(?i)([0-9a-f]{2}h)"), F.lit(1))))
    codes = F.array_distinct(F.transform(found, lambda c: F.concat(F.upper(F.substr(c, F.lit(1), F.lit(2))), F.lit("h"))))
    names = F.filter(F.transform(entries, lambda e: F.trim(F.regexp_replace(e, code, ""))), lambda n: n != "")
    return F.array_join(codes, "/"), F.array_join(names, "；")


def comparison_rows(rows: DataFrame) -> DataFrame:
    """The 21 columns of the comparison sheet and preview.

    `rows` are compared specification rows: product, spec_type, symbol, parameter, condition, limits, unit, description,
    page, old_page, status, changes, conflict, candidates (array of max, typ, min, unit, page) and what commands gave
    them: opcode, mode, section, address, dummy, start, commands; nulls are blank.
    """
    status, removed = F.col("status"), F.col("status") == "removed"
    codes, names = named_opcodes(F.col("commands"))
    opcode, own = normalize_opcode(F.col("opcode")), F.when(F.col("mode").isNotNull(), interface_mode(F.col("mode"), F.col("section")))
    candidates = F.coalesce("candidates", F.array().cast(rows.schema["candidates"].dataType))
    offer = lambda p, i: F.concat(F.lit("舊版候選 "), (i + 1).cast("string"), F.lit("："), F.concat_ws("、", *[F.concat(F.lit(f"{k} "), shown(p[k])) for k in ("max", "typ", "min", "unit")]), F.lit("（舊版頁 "), shown(p["page"]), F.lit("）"))
    review = F.coalesce(F.nullif("conflict", F.lit("")), F.array_join(F.concat(F.array(F.lit(SPEC_NOTES["review"])), F.transform(candidates, offer)), "\n"))
    note = F.when(status == "changed", change_text(F.col("changes"))).when(status == "review", review).otherwise(labelled(status, {k: v for k, v in SPEC_NOTES.items() if k != "review"}))
    page = F.col("page").cast("string")
    old = F.when(removed, page).when(status == "review", F.array_join(F.array_distinct(F.filter(F.transform(candidates, lambda p: p["page"]), lambda p: p != "")), ", ")).otherwise(F.col("old_page"))
    fields = F.when(status == "changed", F.array_join(F.transform("changes", lambda x: x["field"]), ", ")).otherwise("")
    values = (labelled(status, STATUS_LABELS), fields, note, F.col("product"), F.coalesce(F.nullif(opcode, F.lit("")), normalize_opcode(codes)), F.col("unit"), F.col("max"), F.col("typ"), F.col("min"), F.col("symbol"),
              F.coalesce(F.nullif(own, F.lit("")), related_interface(names), own), F.col("address"), limit_text(strip_dummy_notes(F.col("dummy"))), F.col("start"), F.col("spec_type"), names,
              F.col("parameter"), F.col("condition"), F.col("description"), F.when(removed, "").otherwise(page), old)
    return rows.select(*[v.cast("string").alias(c) for v, c in zip(values, COMPARE_HEADERS)])


def runs(chunks: Column) -> Column:
    """Styled runs (text, style) of a word difference: plain, gone, come, part_old, part_new; CELL characters, then a mark."""
    each = F.flatten(F.transform(chunks, lambda c: F.when(c["t"] == "part", F.array(F.struct(c["o"].alias("text"), F.lit("part_old").alias("style")), F.struct(c["n"].alias("text"), F.lit("part_new").alias("style")))).otherwise(
        F.array(F.struct(c["v"].alias("text"), F.when(c["t"] == "del", "gone").when(c["t"] == "ins", "come").otherwise("plain").alias("style"))))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<text:string,style:string>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        text = F.substr(F.coalesce(r["text"], F.lit("")), F.lit(1), F.greatest(F.lit(0), CELL - acc["used"]))
        more = F.when(F.length(text) > 0, F.concat(acc["out"], F.array(F.struct(text.alias("text"), r["style"].alias("style"))))).otherwise(acc["out"])
        return F.struct((acc["used"] + F.length(text)).alias("used"), more.alias("out"))

    full = F.aggregate(each, start, step)
    return F.when(full["used"] >= CELL, F.concat(full["out"], F.array(F.struct(F.lit(CUT_MARK).alias("text"), F.lit("plain").alias("style"))))).otherwise(full["out"])


def narrative_rows(paragraphs: DataFrame, titles: DataFrame, by: Sequence[str]) -> DataFrame:
    """The text sheet: for each section, in order, a row for its title where that differs, then one for each paragraph pair.

    `titles`: by, section (place in the report), old_title, new_title, their numbers, chunks of the title difference or
    null. `paragraphs`: by, section, position, status, old_text, new_text, chunks.
    """
    real = F.exists("chunks", lambda c: c["t"].isin("del", "ins"))
    mark = F.array(F.struct(F.lit("eq").alias("t"), F.lit(TITLE_MARK).alias("v"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("n")))
    names = titles.select(*by, "section", cut_cell(section_label(F.col("new_number"), F.col("new_title"))).alias("new_section"), cut_cell(section_label(F.col("old_number"), F.col("old_title"))).alias("old_section"))
    heads = titles.filter(F.col("chunks").isNotNull()).select(*by, "section", F.lit(-1).cast("long").alias("position"), F.when(real, "changed").otherwise("part").alias("status"), F.col("old_title").alias("old_text"), F.col("new_title").alias("new_text"), runs(F.concat(mark, "chunks")).alias("runs"))
    body = paragraphs.select(*by, "section", F.col("position").cast("long").alias("position"), "status", "old_text", "new_text", F.when(F.col("status") != "same", runs(F.col("chunks"))).alias("runs"))
    rows = heads.unionByName(body).join(names, [*by, "section"])
    return rows.select(*by, "section", "position", labelled(F.col("status"), TEXT_STATUS_LABELS).alias("result"), "new_section", "old_section", "runs", cut_cell(F.col("old_text")).alias("old_text"), cut_cell(F.col("new_text")).alias("new_text"))


def narrative_filter(sections: DataFrame, paragraphs: DataFrame, by: Sequence[str], status: str = "", search: str = "", hide_part: bool = False, only_diff: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sections of a status (`diff`: any but same) whose label or paragraphs hold `search`, and their paragraphs.

    With `hide_part` mere part-number changes count as same everywhere; with `only_diff` same paragraphs are left out.
    """
    seen = lambda df: df.withColumn("status", F.when((F.col("status") == "part") & hide_part, "same").otherwise(F.col("status")))
    sections, paragraphs = seen(sections), seen(paragraphs)
    if status:
        sections = sections.filter(F.col("status") != "same" if status == "diff" else F.col("status") == status)
    if search:
        held = lambda *c: F.lower(F.concat_ws(" ", *c)).contains(search.lower())
        texts = paragraphs.filter(held("old_text", "new_text")).select(*by).distinct().withColumn("_text", F.lit(True))
        sections = sections.join(texts, list(by), "left").filter(F.col("_text").isNotNull() | held("old_label", "new_label")).drop("_text")
    kept = paragraphs.join(sections.select(*by), list(by), "left_semi")
    return sections, kept.filter(F.col("status") != "same") if only_diff else kept


def repaired(pairs: DataFrame, choices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Section pairs (by, new_idx, old_idx) after choices (by, at, new_idx, old_idx) made by hand, in the order of `at`.

    The last choice for a new section counts; an old section chosen for one leaves whatever other one had it, and the
    last that chose it keeps it. Old sections that nobody has are not rows of the result.
    """
    last = choices.groupBy(*by, "new_idx").agg(F.max(F.struct("at", "old_idx")).alias("c"))
    owner = last.select(*by, "new_idx", "c.at", F.col("c.old_idx").alias("chosen"))
    taken = owner.filter(F.col("chosen").isNotNull()).groupBy(*by, F.col("chosen").alias("old_idx")).agg(F.max_by("new_idx", "at").alias("_holder"))
    merged = pairs.filter(F.col("new_idx").isNotNull()).join(owner.withColumn("_own", F.lit(True)), [*by, "new_idx"], "left").withColumn("old_idx", F.when(F.col("_own"), F.col("chosen")).otherwise(F.col("old_idx")))
    held = merged.join(taken, [*by, "old_idx"], "left")
    return held.select(*by, "new_idx", F.when(F.col("_holder").isNull() | (F.col("_holder") == F.col("new_idx")), F.col("old_idx")).alias("old_idx"))


def with_old(new: DataFrame, old: DataFrame, label: str) -> DataFrame:
    """Sources or review entries of both revisions; the old ones' label says so."""
    return new.unionByName(old.withColumn(label, F.concat(F.lit(OLD_PREFIX), F.coalesce(label, F.lit("")))), allowMissingColumns=True)


def with_commands(specs: DataFrame, command_specs: DataFrame) -> DataFrame:
    """Specification rows and those that instructions gave, one table; columns of one side only are null on the other."""
    return specs.unionByName(command_specs, allowMissingColumns=True)


def source_pages(sources: DataFrame, used: DataFrame, pages: DataFrame, doc: Sequence[str], note: str) -> DataFrame:
    """Sources (doc, page, label, text) and the pages that `used` (doc, page, label) names and that aren't there yet.

    A used page is followed by the next one if that begins with notes (`notes_follow`), under the label `note`.
    """
    wanted = used.groupBy(*doc, "page").agg(F.min("label").alias("label"), F.lit(0).alias("_k"))
    following = used.select(*doc, (F.col("page") + 1).alias("page")).distinct().join(pages.filter("notes_follow").select(*doc, "page"), [*doc, "page"], "left_semi").select(*doc, "page", F.lit(note).alias("label"), F.lit(1).alias("_k"))
    offered = wanted.unionByName(following).groupBy(*doc, "page").agg(F.min_by("label", "_k").alias("label"))
    more = offered.join(sources.select(*doc, "page"), [*doc, "page"], "left_anti").join(pages.select(*doc, "page", "text"), [*doc, "page"])
    return sources.unionByName(more)


def distinct_products(rows: DataFrame, doc: Sequence[str], product: str = "product") -> DataFrame:
    """The products of each document, sorted."""
    return rows.filter(F.col(product).isNotNull()).groupBy(*doc).agg(F.sort_array(F.collect_set(product)).alias("products"))


def with_file(df: DataFrame, old_name: str | None = None) -> DataFrame:
    """Rows of files with the file's name, the compared one's, and whether there is one."""
    return df.withColumns({"filename": F.col("_metadata.file_name"), "old_filename": F.lit(old_name), "compared": F.lit(old_name is not None)})


def comparison_markdown(sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """One Markdown text for each pair of documents: a header, the new document, a rule, the old one (side, ord, line)."""
    side = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("ord", "line")))), lambda x: x["line"]), "\n\n")
    both = sections.groupBy(*by).agg(side("new").alias("_new"), side("old").alias("_old"))
    return both.select(*by, F.concat(F.lit("# 新版\n\n"), "_new", F.lit("\n\n---\n\n# 舊版\n\n"), "_old").alias("markdown"))


def exported(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """What a download holds: all rows of the snapshot, or those that the current filter shows."""
    return rows if wanted is None else rows.filter(wanted)


