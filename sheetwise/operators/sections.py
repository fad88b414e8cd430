"""Prose of a document: text segments in reading order to numbered sections and their paragraphs.

Headings are told by number, size and the contents; what a paragraph is follows from each segment and the one before it.
Both are windows over a document's segments; only titles that go on and chapters that are left out fold a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.text import BLANK, ends_sentence, join_wrapped, title_key
from sheetwise.operators import ordered as seq
from sheetwise.operators.cuts import dealt
from sheetwise.operators.documents import reflow

#: Numbered titles, list entries, captions, chapters that are left out with all below them (fixed patterns).
HEADING = r"^(\d{1,2}(?:\.\d{1,3}){0,5})\.?(?:\s+|(?=[A-Z][a-z]))(\S.*)$"
LIST_START = r"(?i)^(?:[•●▪◦■□➢►‣∙·]|[-–—](?=\s)|\(?\d{1,2}[.)](?=\s)|\(?[a-z][.)](?=\s)|Notes?\s*:)"
CAPTION = r"(?i)^(?:Figure|Table)\s+\d"
EXCLUDED = r"(?i)^(?:REVISION HISTORY|REVISION TABLE|TABLE OF CONTENTS|IMPORTANT NOTICE)(?![A-Za-z0-9_])"
FRONT = "(封面與前言)"
#: Shares of the body's height and points above it that make small print and headings; part of the width that headings start in.
MINOR, BIGGER, LEFT = 0.9, 0.8, 0.3
#: Line distances, in heights, within a title and a paragraph; points that a line ends short of the others.
TITLE_STEP, STEP, SHORT = 1.9, 2.4, 35.0


def body_height(segments: DataFrame, doc: Sequence[str]) -> DataFrame:
    """(doc, h): the height of most characters, to half a point; of ties the one that comes first."""
    rows = segments.withColumns({"h": F.round(F.col("h") * 2) / 2, "_o": F.row_number().over(Window.partitionBy(*doc).orderBy("page", "y", "x0"))})
    return seq.weighted_mode(rows, doc, "h", F.length("text"), F.col("_o"))


def in_reading_order(segments: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Segments (page, width, x0, x1, y, h, text) of a size with the body or larger, numbered through the document as `seq`.

    `edge` is how far right any of them on the same half of the page reaches, headings too.
    """
    sized = segments.join(dealt(body_height(segments, doc).withColumnRenamed("h", "body")), list(doc)).filter(F.col("h") >= F.col("body") * MINOR)
    read = seq.reading_order(sized, [*doc, "page"], "x0", "y", F.col("width") / 2)
    read = read.withColumn("edge", F.max("x1").over(Window.partitionBy(*doc, "page", F.col("x0") >= F.col("width") / 2 - 5)))
    return read.withColumn("seq", F.row_number().over(Window.partitionBy(*doc).orderBy("page", "reading"))).drop("reading")


def headings(segments: DataFrame, entries: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Ordered segments with `number` and `title` on those that begin a section, and `absorbed` on those that go on its title.

    A numbered line at the left is a heading if it is large, or if the contents (doc, number, title) list one that begins
    so. A large title goes on through large lines; a listed one as long as it stays a beginning of the listed title.
    """
    number, rest = F.regexp_extract("text", HEADING, 1), F.regexp_extract("text", HEADING, 2)
    lines = segments.withColumns({"_number": number, "_rest": rest, "_key": title_key(rest)})
    listed = entries.select(*doc, F.col("number").alias("_number"), title_key(F.col("title")).alias("_listed")).distinct()
    known = lines.filter("_number != ''").join(dealt(listed), [*doc, "_number"]).filter((F.length("_key") >= 3) & F.startswith("_listed", "_key")).groupBy(*doc, "seq").agg(F.min("_listed").alias("_listed"))
    lines = lines.join(dealt(known), [*doc, "seq"], "left")
    big = F.col("h") >= F.col("body") + BIGGER
    starts = (F.col("_number") != "") & (big | F.col("_listed").isNotNull()) & (F.col("x0") < F.col("width") * LEFT) & F.col("_rest").rlike("[A-Za-z]")
    w = Window.partitionBy(*doc).orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_starts", starts).withColumn("section", F.sum(F.col("_starts").cast("long")).over(run))
    inside = Window.partitionBy(*doc, "section").orderBy("seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"_k": F.row_number().over(inside) - 1, "_head": F.first(F.when(F.col("_starts"), F.struct("page", "h", "_listed")), ignorenulls=True).over(so_far), "_above": F.lag("y").over(inside)})
    # Lines that may belong to the title follow the heading closely on its page; only those are put together, however many.
    close = (F.col("page") == F.col("_head.page")) & ~F.col("text").rlike(HEADING) & (F.col("y") - F.col("_above") < F.col("_head.h") * TITLE_STEP) & (big | F.col("_head._listed").isNotNull())
    lines = lines.withColumn("_near", F.min(F.coalesce(F.col("_starts") | close, F.lit(False)).cast("int")).over(so_far) == 1)
    lines = lines.withColumn("_so_far", F.when(F.col("_near"), F.array_join(F.collect_list(F.when(F.col("_near"), F.when(F.col("_starts"), F.col("_rest")).otherwise(F.col("text")))).over(so_far), " ")))
    more = F.col("_head._listed").isNull() | F.startswith(F.col("_head._listed"), title_key(F.col("_so_far")))
    lines = lines.withColumn("_on", F.min(F.coalesce(F.col("_starts") | (F.col("_near") & more), F.lit(False)).cast("int")).over(so_far) == 1)
    lines = lines.withColumn("absorbed", F.col("_on") & ~F.col("_starts"))
    title = F.max(F.when(F.col("_on") & (F.col("section") > 0), F.struct("_k", "_so_far"))).over(Window.partitionBy(*doc, "section"))
    return lines.withColumns({"number": F.when(F.col("_starts"), F.col("_number")), "title": F.when(F.col("_starts"), F.trim(F.regexp_replace(title["_so_far"], BLANK + "+", " ")))}).select(*segments.columns, "section", "number", "title", "absorbed")


def left_out(titles: DataFrame, doc: Sequence[str]) -> DataFrame:
    """(doc, section) of the chapters that aren't compared, and of all sections below them."""
    each = F.struct("section", F.size(F.split("number", r"\.")).alias("level"), F.col("title").rlike(EXCLUDED).alias("named"))
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<bigint>").alias("out"))  # `open`: level of the chapter that is left out, or 0

    def step(acc: Column, x: Column) -> Column:
        still = F.when((acc["open"] > 0) & (x["level"] > acc["open"]), acc["open"]).otherwise(0)
        now = F.when((still == 0) & x["named"], x["level"]).otherwise(still)
        return F.struct(now.alias("open"), F.when(now > 0, F.concat(acc["out"], F.array(x["section"]))).otherwise(acc["out"]).alias("out"))

    return titles.groupBy(*doc).agg(F.sort_array(F.collect_list(each)).alias("_s")).select(*doc, F.explode(F.aggregate("_s", start, step)["out"]).alias("section"))


def paragraphs(lines: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Paragraphs (doc, section, paragraph, kind, text, page, end_page) of segments without headings.

    One begins at captions and list entries, after a caption, on a new page after the end of a sentence, after a short
    line that ends one, after a wide gap, and where a column begins.
    """
    caption, entry = F.col("text").rlike(CAPTION), F.col("text").rlike(LIST_START)
    w = Window.partitionBy(*doc, "section").orderBy("seq")
    last = F.lag(F.struct("page", "y", "x1", "edge", "text")).over(w)
    lines = lines.withColumns({"kind": F.when(caption, "caption").when(entry, "list").otherwise("text"), "_last": last}).withColumn("_before", F.lag("kind").over(w))
    ended = (F.col("_last.x1") < F.col("_last.edge") - SHORT) & F.col("_last.text").rlike("[.:!?]$")
    same_page = ended | (F.col("y") - F.col("_last.y") > F.col("h") * STEP) | (F.col("y") < F.col("_last.y"))
    fresh = F.col("_last").isNull() | (F.col("kind") != "text") | (F.col("_before") == "caption") | F.when(F.col("_last.page") != F.col("page"), ends_sentence(F.col("_last.text"))).otherwise(same_page)
    numbered = lines.withColumn("paragraph", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.sort_array(F.collect_list(F.struct("seq", "text", "kind")))
    grouped = numbered.groupBy(*doc, "section", "paragraph").agg(pieces.alias("_p"), F.min("page").alias("page"), F.max("page").alias("end_page"))
    whole = F.aggregate("_p", F.lit(""), lambda acc, p: join_wrapped(acc, p["text"]))
    return grouped.select(*doc, "section", "paragraph", F.get("_p", F.lit(0))["kind"].alias("kind"), F.trim(F.regexp_replace(whole, BLANK + "+", " ")).alias("text"), "page", "end_page").filter("text != ''")


def built_sections(segments: DataFrame, entries: DataFrame, doc: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(sections, paragraphs) of all documents: titles in order, the front matter as section 0 if it has any text."""
    lines = headings(in_reading_order(segments, doc), entries, doc)
    titles = lines.filter("title is not null").select(*doc, "section", "number", "title", "page")
    out = left_out(titles, doc)
    body = paragraphs(lines.filter("title is null and not absorbed"), doc).join(dealt(out), [*doc, "section"], "left_anti")
    front = body.filter("section = 0").groupBy(*doc).agg(F.min("page").alias("page")).select(*doc, F.lit(0).cast("long").alias("section"), F.lit("").alias("number"), F.lit(FRONT).alias("title"), "page")
    return front.unionByName(titles.join(dealt(out), [*doc, "section"], "left_anti")), body


def narrative(segments: DataFrame, entries: DataFrame, doc: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(sections, sentences): the sections and their paragraphs, wrapped pieces joined and cut into sentences."""
    titles, body = built_sections(segments, entries, doc)
    return titles, reflow(body, [*doc, "section"], "paragraph")
