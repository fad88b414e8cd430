"""Markdown documents: one file each, written by the executors in document order; nothing passes the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions.text import page_span, section_label
from sheetwise.sources.workbook import heading, markdown_lines

#: Lines below a document's title.
NOTES = ("> Page ranges are places in the source, not differences in meaning.",)


def document_lines(sections: DataFrame, paragraphs: DataFrame, doc: str, notes: Sequence[str] = NOTES) -> DataFrame:
    """(doc, at, line) of each document: its title and notes, then headings and paragraphs with a blank line before each.

    Sections: doc, name, section, number, title. Paragraphs: doc, section, paragraph, sentence, kind, text, page, end_page;
    list entries get a dash, and places in the source a comment. `at` orders the lines of a document.
    """
    at = lambda section, paragraph=-1, sentence=-1, k=0: F.struct(*[(c if not isinstance(c, int) else F.lit(c)).cast("long").alias(n) for n, c in (("section", section), ("paragraph", paragraph), ("sentence", sentence), ("k", k))])
    names = sections.groupBy(doc).agg(F.min("name").alias("name"))
    head = names.select(doc, F.posexplode(F.array(F.concat(F.lit("# "), "name"), *[F.lit(n) for n in ("", *notes)])).alias("k", "line")).select(doc, at(-1, k=F.col("k")).alias("at"), "line")
    level = F.when(F.col("number") != "", F.size(F.split("number", r"\."))).otherwise(0)
    titled = sections.select(doc, F.col("section"), heading(level, section_label(F.coalesce("number", F.lit("")), F.coalesce("title", F.lit("")))).alias("line"))
    titled = titled.select(doc, F.col("section"), F.posexplode(F.array(F.lit(""), "line")).alias("k", "line")).select(doc, at(F.col("section"), k=F.col("k")).alias("at"), "line")
    told = markdown_lines(paragraphs.withColumn("span", page_span(F.col("page"), F.col("end_page"))))
    body = told.select(doc, "section", "paragraph", "sentence", F.posexplode(F.array(F.lit(""), "line")).alias("k", "line"))
    return head.unionByName(titled).unionByName(body.select(doc, at(F.col("section"), F.col("paragraph"), F.col("sentence"), F.col("k")).alias("at"), "line"))


def write_documents(lines: DataFrame, doc: str, path: str) -> None:
    """A folder for each document below `path`, with one text file: a document is one task's, documents spread over all tasks."""
    ordered = lines.repartition(doc).sortWithinPartitions(doc, "at")
    ordered.select(doc, F.col("line").alias("value")).write.partitionBy(doc).text(path)


def read_documents(spark: SparkSession, path: str, doc: str, kind: str = "long") -> DataFrame:
    """(doc, content) of written documents."""
    return spark.read.schema(f"value string, {doc} {kind}").text(path, wholetext=True).select(doc, F.col("value").alias("content"))
