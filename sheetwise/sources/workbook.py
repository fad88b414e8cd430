"""Spreadsheet and Markdown sinks. A workbook is one file on the driver, so row counts are checked against its limit."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a worksheet (a limit of the format).
MOST_ROWS = 1_048_576
ILLEGAL = {c: None for c in range(32) if c not in (9, 10, 13)}


def cell(value: object) -> str:
    """Numbers stay numbers; everything else is inline text, so nothing becomes a formula."""
    if value is None or value == "":
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value).translate(ILLEGAL))}</t></is></c>'


def workbook(sheets: Mapping[str, DataFrame]) -> bytes:
    """An XLSX file with the given sheets, in order: a frozen header row with filters, then the rows."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, df in enumerate(sheets.values(), 1):
            if df.count() >= MOST_ROWS:
                raise ValueError("a worksheet can't hold so many rows; write a table instead")
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                write = lambda s: f.write(s.encode("utf-8", "replace"))  # noqa: B023, E731
                write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>')
                write("<row>" + "".join(map(cell, df.columns)) + "</row>")
                for row in df.toLocalIterator():
                    write("<row>" + "".join(map(cell, row)) + "</row>")
                write("</sheetData></worksheet>")
        n = range(1, len(sheets) + 1)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{sheet_type}.worksheet+xml"/>' for k in n) + "</Types>")
    return out.getvalue()


def heading(level: Column, title: Column) -> Column:
    """Markdown heading of a section: level 1 is two marks, deeper ones one more, six at most."""
    return F.concat(F.repeat(F.lit("#"), F.when(level > 1, F.least(F.lit(6), level + 1)).otherwise(2).cast("int")), F.lit(" "), title)


def markdown_lines(paragraphs: DataFrame) -> DataFrame:
    """Lines of (kind, text, span): a page comment where there is a span, then the paragraph, lists with a dash."""
    body = F.when((F.col("kind") == "list") & ~F.col("text").rlike("^[-*•●]"), F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return paragraphs.withColumn("line", F.concat(F.when(F.col("span") != "", F.concat(F.lit("<!-- PDF page "), "span", F.lit(" -->\n"))).otherwise(""), body))
