"""Operator 4: WARC archives and a salvage reader.

Writing goes through Spark's own text sink and committer, so archives land on any store Spark can write and survive
lost or repeated tasks: a row is one record, and the line separator is the blank line pair that ends a record.

Reading checks every record: version line, header block, Content-Length, closing blank lines, payload digest. After a
failed check it searches onward for the next gzip member or version line that passes, and logs the bytes between as a
quarantined gap, so damage costs the damaged records only. Plain archives and archives of gzip members (one or more
records each) are both read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import join_counted, scratch_dir, stored

CRLF = "\r\n"
ENDING = b"\r\n\r\n"
#: Records and bytes of an archive file, at most: a reader task holds about 8 MB of ordinary pages at once.
#: Only a record that is longer by itself makes a longer archive, which it has to itself.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2000, 64 << 20
#: Bytes of a record besides payload and url, at most.
FIXED_BYTES = 1024
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
STARTS = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")

#: Columns of a parsed archive: of a gap, those after `reason` are null; of a record, `reason` is.
RECORD = "archive string, kind string, start long, length long, reason string, type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string"
#: Rows that the reader hands over at once; bytes of a gzip member that are unpacked at once.
ROWS, CHUNK = 500, 1 << 16


def header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line breaks in values are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def record_bytes() -> Column:
    """Bytes that the record of a page takes, at most: each line break of a url becomes three."""
    return (F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 3 * F.coalesce(F.octet_length(F.col("url").cast("string")), F.lit(0)).cast("long") + FIXED_BYTES)


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """`value`: the WARC record of each page (page_id, url, html), without its closing blank lines; `bytes`: its size, at most.

    Of pages with equal payloads of at least LEAST_REVISIT bytes, the smallest page_id is the response (every row that
    has it, if rows repeat; null ids last) and the others are revisits without payload. Null html is an empty payload.
    """
    payload = F.coalesce("html", F.lit(""))
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"),
                         F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"), record_bytes().alias("bytes"))
    long = plain.filter(F.col("size") >= LEAST_REVISIT)
    groups = stored(long.groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first")).filter("copies > 1"))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    known = join_counted(plain, groups, "digest", "copies", total)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2),
                     F.when(revisit, "").otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return known.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", name("page_id")),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Date", F.lit(date)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        header("WARC-Refers-To", F.when(revisit, name("first"))),
        header("WARC-Profile", F.when(revisit, PROFILE)),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block).alias("value"), "bytes")


def write_archives(pages: DataFrame, path: str, archive_records: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages to WARC files below `path`; an empty table leaves a folder without records.

    Long records go to archives of fewer records, one write for each class of lengths that occurs.
    """
    longest = pages.agg(F.max(record_bytes())).first()[0] or 0
    made, least, most, count = records(pages), 0, 0, archive_records
    while not least or most < longest:
        most = longest if count == 1 else archive_bytes // count
        own = made.filter((F.col("bytes") > least) & (F.col("bytes") <= most)) if least or most < longest else made
        own.select("value").write.mode("append" if least else "error").option("lineSep", CRLF * 2).option("maxRecordsPerFile", count).text(path)
        least, count = max(most, 1), max(1, count // 32)


def parse_record(data: bytes, at: int) -> dict | str:
    """The record that starts at `at`, or why it isn't valid."""
    end = data.find(ENDING, at)
    if end < 0:
        return "no end of the header block"
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        return "no length or type"
    start = end + len(ENDING)
    stop = start + int(fields["content-length"])
    if data[stop : stop + len(ENDING)] != ENDING:
        return "length doesn't lead to the end of a record"
    block = data[start:stop]
    head, cut, payload = block.partition(ENDING) if "application/http" in fields.get("content-type", "") else (b"", ENDING, block)
    if not cut:
        return "no end of the HTTP header"
    size, stated = len(payload), fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "revisit":
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        size = int(found[1]) if found else None
    elif stated.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != stated[7:].lower():
        return "payload digest differs"
    clean = lambda v: v.strip("<>") if v is not None else None
    return {"kind": "record", "start": at, "length": stop + len(ENDING) - at, "type": fields["warc-type"], "record_id": clean(fields.get("warc-record-id")),
            "refers_to": clean(fields.get("warc-refers-to")), "uri": fields.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": stated[7:].lower() if stated.startswith("sha256:") else hashlib.sha256(payload).hexdigest(), "payload": payload}


def unpacked(data: bytes, at: int) -> tuple[bytes, int] | str:
    """What the gzip member at `at` holds and where it ends, or why it isn't valid. Only the member itself is read."""
    stream, parts, place = zlib.decompressobj(31), [], at
    try:
        while not stream.eof and place < len(data):
            parts.append(stream.decompress(data[place : place + CHUNK]))
            place = min(len(data), place + CHUNK)
    except zlib.error as e:
        return f"gzip: {e}"
    return (b"".join(parts), place - len(stream.unused_data)) if stream.eof else "gzip member is cut off"


def parse_member(data: bytes, at: int) -> tuple[list[dict], int] | str:
    """The records of the gzip member at `at` and where the member ends, or why it isn't valid."""
    member = unpacked(data, at)
    if isinstance(member, str):
        return member
    inside, end = member
    found, k = [], 0
    while k < len(inside):
        record = parse_record(inside, k) if STARTS.match(inside, k) else "no version line"
        if isinstance(record, str):
            return record
        k += record["length"]
        found.append(record | {"start": at, "length": end - at})
    return found, end


def salvage(data: bytes) -> Iterator[dict]:
    """Valid records in order, and the gaps between them with the reason of the first failed check."""
    at, lost, why = 0, None, ""
    last = data.rfind(ENDING)  # no plain record starts after this: no search to the end of the file for each false start
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            result = parse_member(data, at)
        else:
            result = "no version line" if not STARTS.match(data, at) else "no end of the header block" if at > last else parse_record(data, at)
        if isinstance(result, str):
            if lost is None:
                lost, why = at, result
            onward = STARTS.search(data, at + 1)
            at = onward.start() if onward else len(data)
            continue
        if lost is not None:
            yield {"kind": "gap", "start": lost, "length": at - lost, "reason": why}
            lost = None
        yield from result[0] if isinstance(result, tuple) else [result]
        at = result[1] if isinstance(result, tuple) else at + result["length"]
    if lost is not None:
        yield {"kind": "gap", "start": lost, "length": len(data) - lost, "reason": why}


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of kind `record` and `gap` of all archives below `path`; with `payloads`, the payload bytes as well.

    Every byte of an archive lies in one record (or member) or in one gap. An empty folder or file gives no rows.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    typed = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                found = salvage(content.as_py())
                while rows := list(itertools.islice(found, ROWS)):
                    yield pa.RecordBatch.from_pylist([r | {"archive": archive.as_py()} for r in rows], typed)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


def quarantine(parsed: DataFrame) -> DataFrame:
    """The log of byte gaps that the reader passed over."""
    return parsed.filter(F.col("kind") == "gap").select("archive", "start", "length", "reason")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails if the reader meets a gap: these archives are undamaged, so every page must come back."""
    path = scratch_dir(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(substr({c}, {len(ID) + 1}) as bigint)")
    lost = F.raise_error(F.concat_ws(" ", F.lit("not read back:"), "archive", F.col("start").cast("string"), "reason"))
    return read_archives(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.when(F.col("kind") == "gap", lost.cast("string")).otherwise(F.col("type")).alias("record_type"),
        page("refers_to").alias("refers_to"))


ORACLE_OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= {LEAST_REVISIT}
"""
