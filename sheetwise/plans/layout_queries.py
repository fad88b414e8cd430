"""Queries of page layout, scalar predicates and page choice over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheetwise.functions import text as t
from sheetwise.operators import documents as doc
from sheetwise.operators import layout
from sheetwise.sources import items as src
from sheetwise.plans.text_queries import SQL_BLANK, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text_of(n: str, *choices: str):
    """One of several texts by a number column, in Spark."""
    c = F.col(n) % len(choices)
    out = F.lit(choices[0])
    for k, x in enumerate(choices[1:], 1):
        out = F.when(c == k, F.expr(x[1:]) if x.startswith("=") else F.lit(x)).otherwise(out)
    return out


#: Names of commands that parts get here, in SQL that both engines read.
NAMES = """CASE p_partkey % 7 WHEN 0 THEN 'Fast Read Dual I / O with 4-Byte Address' WHEN 1 THEN 'Set Read Parameters (C0h)' WHEN 2 THEN 'Read JEDEC ID 9Fh'
 WHEN 3 THEN 'Page Program (02h/32h)' WHEN 4 THEN 'Unique ID ' || p_size || 'h' WHEN 5 THEN p_name || ' I/O' ELSE 'spread ' || p_name END"""


@query(f"""WITH p AS (SELECT p_partkey, {NAMES} AS name FROM part)
SELECT p_partkey,
  lower(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\\bI\\s*/\\s*O\\b', 'IO', 'g'), '(?i)\\s+with\\s+[34][- ]Byte\\s+Addr(?:ess)?$', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS command,
  lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key,
  NOT regexp_matches(name, '(?i)^Set\\b') AND regexp_matches(name, '(?i)\\bread\\b|(?:device|JEDEC|unique)\\s*ID\\b') AS reads,
  array_to_string(list_distinct_in_order, '/') AS codes
FROM (SELECT *, list_reduce(list_transform(regexp_extract_all(name, '(?i)\\b([0-9a-f]{{2}})h?\\b', 1), lambda x: [upper(x) || 'h']), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE a || x END, []::VARCHAR[]) AS list_distinct_in_order FROM p)""")
def q_command_names(spark, sf_dir):
    name = F.expr(NAMES.replace("\n", " "))
    return table(spark, sf_dir, "part").select("p_partkey", t.command_name(name).alias("command"), t.name_key(name).alias("key"), t.is_read(name).alias("reads"), F.array_join(t.codes(name), "/").alias("codes"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey % 5 AS k, CASE s_nationkey % 5 WHEN 0 THEN '8.3 DC Electrical ' || s_name WHEN 1 THEN 'AC Measurement' WHEN 2 THEN 'ACDC rules' WHEN 3 THEN 'ac timing, not DC' ELSE s_name END AS label,
  CASE s_nationkey % 5 WHEN 0 THEN 'Read（1-1-1, 4-4-4）' WHEN 1 THEN 'only 1-1-1' WHEN 2 THEN '4-4-4' WHEN 3 THEN '1-1-1-1 and x4-4-4' ELSE s_name END AS modes FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_matches(label, '(?i)\\bDC\\b') THEN 'DC' WHEN regexp_matches(label, '(?i)\\bAC\\b') THEN 'AC' ELSE 'Other' END AS kind,
  CASE k WHEN 0 THEN 'Both' WHEN 1 THEN 'SPI' WHEN 2 THEN 'QPI' END AS interface FROM s""")
def q_section_kinds(spark, sf_dir):
    k = "s_nationkey"
    label = text_of(k, "", "AC Measurement", "ACDC rules", "ac timing, not DC", "=s_name")
    label = F.when(F.col(k) % 5 == 0, F.concat(F.lit("8.3 DC Electrical "), "s_name")).otherwise(label)
    modes = text_of(k, "Read（1-1-1, 4-4-4）", "only 1-1-1", "4-4-4", "1-1-1-1 and x4-4-4", "=s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.spec_kind(label).alias("kind"), t.related_interface(modes).alias("interface"))


@query("""WITH p AS (SELECT p_partkey, p_size AS a, least(p_size + p_partkey % 9, 55) AS b, p_partkey % 4 AS k FROM part)
SELECT p_partkey, array_to_string(CASE k WHEN 0 THEN ['AB25Q' || (a + 10) || 'RW', 'AB25Q' || (a + 11) || 'RW']
    WHEN 1 THEN list_transform(range(a + 10, b + 11), lambda n: 'AB25Q' || n || 'RW')
    WHEN 2 THEN list_transform(range(10, 66), lambda n: 'AB25Q' || n || 'RW') || ['CD25Q32RW'] ELSE ['CD25Q32RW'] END, ' ') AS products,
  CASE k WHEN 0 THEN 'only ' || '/' || (a + 11) || 'RW' WHEN 1 THEN '' WHEN 2 THEN 'no model here' ELSE 'and it' END AS rest
FROM p WHERE k <> 0 UNION ALL
SELECT p_partkey, 'AB25Q' || (a + 10) || 'RW AB25Q' || (a + 11) || 'RW', 'AB25Q' || (a + 10) || '/' || (a + 11) || 'RW only' FROM p WHERE k = 0""")
def q_named_products(spark, sf_dir):
    known = F.concat(F.transform(F.sequence(F.lit(10), F.lit(65)), lambda n: F.concat(F.lit("AB25Q"), n.cast("string"), F.lit("RW"))), F.array(F.lit("CD25Q32RW")))
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size as a", "least(p_size + p_partkey % 9, 55) as b", "p_partkey % 4 as k")
    named = F.expr("""CASE k WHEN 0 THEN concat('AB25Q', a + 10, '/', a + 11, 'RW only') WHEN 1 THEN concat('AB25Q', a + 10, 'RW–AB25Q', b + 10, 'RW')
        WHEN 2 THEN 'no model here' ELSE 'cd25q32rw-DTR, and it' END""")
    found = t.products_from_text(named, known)
    return parts.select("p_partkey", F.array_join(found, " ").alias("products"), t.strip_products(named, found).alias("rest"))


#: Abbreviations as a pattern of DuckDB, which has no look-behind.
SQL_ABBREVIATION = r"(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(a.replace(".", r"\.") for a in t.ABBREVIATIONS) + r")\.$"


def _sql_ends(c: str) -> str:
    c = f"regexp_replace({c}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"
    return f"(regexp_matches({c}, '[.!?;:。！？][)\"''\\]]*$') AND NOT regexp_matches(regexp_replace({c}, '[)\"''\\]]+$', ''), '{SQL_ABBREVIATION}'))"


@query(f"""WITH c AS (SELECT item_id, text || CASE item_id % 5 WHEN 0 THEN ' so."' WHEN 1 THEN ' Fig.' WHEN 2 THEN ' e.g.)' WHEN 3 THEN ' re-' ELSE '' END AS a, CASE item_id % 3 WHEN 0 THEN lower(text) ELSE text END AS b FROM benchmark)
SELECT item_id, {_sql_ends('a')} AS ends,
  md5(CASE WHEN regexp_matches(a, '[a-z]{{2,}}-$') AND regexp_matches(b, '^[a-z]') THEN a[:-2] || b ELSE a || ' ' || b END) AS joined,
  md5(regexp_replace(regexp_replace(a, '{SQL_BLANK}+', '', 'g'), '([a-z])-([a-z])', '\\1\\2', 'g')) AS bare FROM c""")
def q_wrapped_text(spark, sf_dir):
    a = F.expr("concat(text, CASE item_id % 5 WHEN 0 THEN ' so.\"' WHEN 1 THEN ' Fig.' WHEN 2 THEN ' e.g.)' WHEN 3 THEN ' re-' ELSE '' END)")
    b = F.expr("CASE item_id % 3 WHEN 0 THEN lower(text) ELSE text END")
    rows = table(spark, sf_dir, "benchmark").select("item_id", a.alias("a"), b.alias("b"))
    return rows.select("item_id", t.ends_sentence(F.col("a")).alias("ends"), F.md5(t.join_wrapped(F.col("a"), F.col("b"))).alias("joined"), F.md5(t.unwrap(F.col("a"))).alias("bare"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_custkey % 3 > 0 THEN o_custkey || '–' || (o_custkey + o_custkey % 3) ELSE o_custkey::VARCHAR END AS span,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE o_orderkey || '.1 ' || o_orderstatus END AS label, CASE WHEN o_orderkey % 4 = 0 THEN '空白' ELSE o_custkey::VARCHAR END AS shown FROM orders""")
def q_labels(spark, sf_dir):
    page = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"))
    number = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".1"))).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.page_span(page, page + F.col("o_custkey") % 3).alias("span"), t.section_label(number, F.col("o_orderstatus")).alias("label"), t.shown(page.cast("string")).alias("shown"))


@query("""SELECT event_id, event_type AS text, 2.0 * event_id + 10 AS x, 800.0 - (user_id % 700) - 0.35 * 12 AS y FROM events WHERE event_id % 3 <> 0""")
def q_text_items(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, " \t").otherwise(F.col("event_type")).alias("text"), F.col("event_id").cast("double").alias("e"), (F.col("user_id") % 700).cast("double").alias("f"),
        *[F.lit(v).cast("double").alias(k) for k, v in (("a", 2), ("b", 0), ("c", 0), ("d", -1), ("tx", 10), ("ty", 800), ("height", 12))])
    return src.text_items(raw).select("event_id", "text", "x", F.round("y", 6).alias("y"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_nationkey + 100 ELSE c_custkey END::INT AS printed, c_custkey % 4 IN (0, 2) AS searched,
  CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS factory FROM customer""")
def q_page_marks(spark, sf_dir):
    n = F.col("c_custkey")
    footer = F.when(n % 3 == 0, F.concat(F.lit("x - "), (F.col("c_nationkey") + 100).cast("string"), F.lit(" - y"))).when(n % 3 == 1, "rev 4 -x-").otherwise("")
    text = F.when(n % 4 == 0, "a\nOpcode table").when(n % 4 == 1, "3 Opcode ........ 12\nopcodes").when(n % 4 == 2, "x\nByte  1 y").otherwise("nothing")
    group = F.when(n % 5 == 0, "Factory Mode").when(n % 5 == 1, "Factory Mode, User-Mode").when(n % 5 == 2, "Factory-Only").otherwise("User Mode")
    return table(spark, sf_dir, "customer").select("c_custkey", doc.printed_page(n.cast("int"), footer).alias("printed"), doc.may_hold_commands(text).alias("searched"), doc.factory_only(F.lit("s"), group).alias("factory"))


@query("""WITH l AS (SELECT user_id, event_id, event_id % 3 = 0 AS dotted FROM events)
SELECT user_id, count(*) FILTER (WHERE dotted)::BIGINT AS n_leaders FROM l GROUP BY user_id HAVING count(*) FILTER (WHERE dotted) >= 4""")
def q_contents_pages(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "1.2 Title ........ 7").otherwise("2 Title . . . . . . 9")).otherwise("a line ... with few dots")
    return doc.contents_pages(table(spark, sf_dir, "events").select("user_id", text.alias("text")), ["user_id"])


@query("""WITH h AS (SELECT p_partkey, p_size AS number, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN left(p_name, 2) ELSE 'Other ' || p_name END AS title FROM part),
e AS (SELECT DISTINCT p_size AS number, regexp_replace(lower(p_name || ' Mode'), '[^a-z0-9]+', '', 'g') AS listed FROM part)
SELECT p_partkey, listed AS listed_title FROM h JOIN e ON h.number = e.number AND length(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')) >= 3 AND starts_with(listed, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'))""")
def q_listed_headings(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("doc"), F.col("p_size").cast("string").alias("number"), "p_name")
    title = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.substr("p_name", F.lit(1), F.lit(2))).otherwise(F.concat(F.lit("Other "), "p_name"))
    entries = parts.select("doc", "number", F.concat("p_name", F.lit(" Mode")).alias("title"))
    return doc.listed_headings(parts.select("doc", "p_partkey", "number", title.alias("title")), entries, ["doc"]).select("p_partkey", "listed_title")


#: Cells here: events are boxes on the pages of their user, in tenths of points.
CELLS = "user_id, event_id, (event_id % 90)::DOUBLE AS x0, (event_id % 90 + 5 + event_id % 7)::DOUBLE AS x1, (event_id % 37 * 1.5)::DOUBLE AS y0, (event_id % 37 * 1.5 + 3 + event_id % 5)::DOUBLE AS y1, event_type AS text"


def cells(spark, sf_dir):
    n = F.col("event_id")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "events").select("user_id", "event_id", d(n % 90).alias("x0"), d(n % 90 + 5 + n % 7).alias("x1"), d(n % 37 * 1.5).alias("y0"), d(n % 37 * 1.5 + 3 + n % 5).alias("y1"), F.col("event_type").alias("text"))


@query(f"""WITH c AS (SELECT {CELLS} FROM events), e AS (SELECT user_id, y0 AS y FROM c UNION SELECT user_id, y1 FROM c),
b AS (SELECT user_id, y AS low, lead(y) OVER (PARTITION BY user_id ORDER BY y) AS high FROM e)
SELECT b.user_id, low, high, event_id FROM b JOIN c ON b.user_id = c.user_id AND y0 <= (low + high) / 2 AND (low + high) / 2 < y1 WHERE high - low >= 2""")
def q_row_bands(spark, sf_dir):
    own = cells(spark, sf_dir)
    return layout.in_bands(own, layout.bands(own, ["user_id"]), ["user_id"]).select("user_id", "low", "high", "event_id")


@query(f"""WITH c AS (SELECT {CELLS} FROM events), p AS (SELECT DISTINCT user_id, (event_id % 50)::DOUBLE AS x, (event_id % 40)::DOUBLE AS y FROM events),
r AS (SELECT p.user_id, x, y, event_id, row_number() OVER (PARTITION BY p.user_id, x, y ORDER BY y0, x0, event_id) AS k FROM p JOIN c ON p.user_id = c.user_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT user_id, x, y, event_id FROM r WHERE k = 1""")
def q_cell_at(spark, sf_dir):
    n = F.col("event_id")
    points = table(spark, sf_dir, "events").select("user_id", (n % 50).cast("double").alias("x"), (n % 40).cast("double").alias("y")).distinct()
    return layout.cell_at(points, cells(spark, sf_dir), ["user_id"], ["x", "y"]).select("user_id", "x", "y", "event_id")


@query(f"""WITH c AS (SELECT {CELLS} FROM events)
SELECT user_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(event_id, (y0, x0, event_id)) AS first_cell FROM c GROUP BY user_id""")
def q_table_boxes(spark, sf_dir):
    own = cells(spark, sf_dir)
    first = layout.reading_rank(own.withColumn("x0", F.col("x0") + F.col("event_id") * 1e-9), ["user_id"]).filter("rank = 1").select("user_id", F.col("event_id").alias("first_cell"))
    return layout.bounding_boxes(own, ["user_id"]).join(first, "user_id")


@query(f"""WITH c AS (SELECT {CELLS} FROM events WHERE event_id % 10 = 0), l AS (SELECT user_id, event_id AS n, (event_id % 53) + event_id * 1e-6 AS y, '3.' || event_id AS text FROM events WHERE event_id % 10 <> 0 AND event_type <> 'view')
SELECT event_id, (SELECT arg_max(text, y) FROM l WHERE l.user_id = c.user_id AND l.y < c.y0) AS heading FROM c""")
def q_heading_above(spark, sf_dir):
    n = F.col("event_id")
    lines = table(spark, sf_dir, "events").filter(n % 10 != 0).select("user_id", ((n % 53) + n * 1e-6).alias("y"), F.concat(F.lit("3."), n.cast("string")).alias("text"), "event_type")
    return layout.heading_above(cells(spark, sf_dir).filter(n % 10 == 0), lines, ["user_id"], F.col("event_type") != "view").select("event_id", "heading")


@query(f"""WITH c AS (SELECT {CELLS} FROM events WHERE event_id % 10 = 0), i AS (SELECT user_id, event_id, (event_id % 97)::DOUBLE AS x, 4.0 AS width, (event_id % 61)::DOUBLE AS y, event_id % 8 = 0 AS listed FROM events WHERE event_id % 10 <> 0)
SELECT event_id FROM i WHERE listed OR NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = i.user_id AND x + width / 2 BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1)""")
def q_outside_tables(spark, sf_dir):
    n = F.col("event_id")
    items = table(spark, sf_dir, "events").filter(n % 10 != 0).select("user_id", "event_id", (n % 97).cast("double").alias("x"), F.lit(4.0).alias("width"), (n % 61).cast("double").alias("y"), (n % 8 == 0).alias("listed"))
    return layout.outside_tables(items, cells(spark, sf_dir).filter(n % 10 == 0), ["user_id"], keep=F.col("listed")).select("event_id")


@query("""WITH i AS (SELECT user_id, event_id, (event_id % 41 * 11)::DOUBLE AS x, (event_id // 41 % 12 * 10)::DOUBLE AS y, event_type AS text, CASE event_id % 3 WHEN 0 THEN 11.0 ELSE 9.0 END AS width FROM events),
g AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR x - (lag(x) OVER w + lag(width) OVER w) > 24 THEN 1 ELSE 0 END AS fresh, x - (lag(x) OVER w + lag(width) OVER w) AS space FROM i WINDOW w AS (PARTITION BY user_id, y ORDER BY x, width, text)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, y ORDER BY x, width, text) AS piece FROM g)
SELECT user_id, y, min(x) AS x0, max(x + width) AS x1, string_agg(CASE WHEN fresh = 0 AND space > 1.8 THEN ' ' ELSE '' END || text, '' ORDER BY x, width, text) AS text FROM s GROUP BY user_id, y, piece""")
def q_segments(spark, sf_dir):
    n = F.col("event_id")
    items = table(spark, sf_dir, "events").select("user_id", (n % 41 * 11).cast("double").alias("x"), (F.floor(n / 41) % 12 * 10).cast("double").alias("y"), F.when(n % 3 == 0, 11.0).otherwise(9.0).alias("width"), F.lit(10.0).alias("height"), F.col("event_type").alias("text"))
    return layout.segments(items, ["user_id"]).select("user_id", "y", "x0", "x1", "text")


#: Pages of a user's document are its events; what a page's title says follows from its number.
@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, event_type FROM events),
e AS (SELECT *, CASE page % 8 WHEN 2 THEN 'DC Electrical Characteristics ' || event_type WHEN 3 THEN 'Operating Ranges' WHEN 5 THEN 'PACKAGE ' || event_type WHEN 6 THEN 'Mode ' || event_type WHEN 7 THEN 'OTHER CHAPTER' END AS label,
  CASE page % 8 WHEN 2 THEN true WHEN 4 THEN true WHEN 5 THEN false WHEN 7 THEN false END AS inside,
  CASE WHEN page % 8 = 4 THEN 'Electrical Characteristics (continued)' END AS again FROM p)
SELECT user_id, page, coalesce(last_value(CASE WHEN again IS NOT NULL THEN again ELSE label END IGNORE NULLS) OVER w, 'Electrical Characteristics') AS label, coalesce(last_value(inside IGNORE NULLS) OVER w, false) AS in_chapter FROM e WINDOW w AS (PARTITION BY user_id ORDER BY page ROWS UNBOUNDED PRECEDING)""")
def q_chapters(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("page") % 8
    pages = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("page"))
    first = (F.when(k == 2, F.concat(F.lit("8.1 DC Electrical Characteristics "), "event_type")).when(k == 3, "8.2 Operating Ranges").when(k == 4, "Electrical Characteristics (continued)").when(k == 5, F.concat(F.lit("9. PACKAGE "), "event_type"))
             .when(k == 6, F.concat(F.lit("9.1 Mode "), "event_type")).when(k == 7, "10 OTHER CHAPTER").otherwise("a running line"))
    second = F.when(k == 5, "8.1 AC Electrical Characteristics").when(k == 1, "Electrical Characteristics ..... 7").otherwise("text")
    line = lambda y, text: F.struct(F.lit(y).alias("y"), text.alias("text"))
    lines = pages.select("user_id", "page", F.explode(F.array(line(50.0, first), line(90.0, second), line(300.0, F.lit("PACKAGE below")))).alias("l")).select("user_id", "page", "l.*")
    return doc.chapters(lines, ["user_id"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS label, o_orderkey % 20 AS page, o_orderkey % 2 = 0 AS factory FROM orders), n AS (SELECT DISTINCT user_id AS label, event_id % 20 AS page FROM events WHERE event_type = 'view')
SELECT o_orderkey, coalesce(' page ' || m || '. Factory mode: VCC range from 1.' || m || 'V  to 3V', '') AS notes, CASE WHEN factory THEN 'Factory Mode' || coalesce('; VCC = 1.' || m || 'V to 3V', '') ELSE 'x' END AS condition
FROM (SELECT *, (SELECT min(n.page) FROM n WHERE n.label = o.label AND n.page >= o.page) AS m FROM o)""")
def q_scoped_notes(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), "o_orderkey", F.col("o_custkey").alias("label"), (n % 20).alias("page"), F.when(n % 2 == 0, "Factory Mode").otherwise("x").alias("condition"))
    at = F.col("page").cast("string")
    noted = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.lit(1).alias("doc"), F.col("user_id").alias("label"), (F.col("event_id") % 20).alias("page")).distinct()
    text = F.concat(F.lit("top\nNotes: page "), at, F.lit(". Factory mode: VCC range from 1."), at, F.lit("V  to 3V\n 9.2 Next\nNotes: no"))
    return doc.scoped_notes(rows, noted.withColumn("text", text), ["doc"]).select("o_orderkey", "notes", "condition")


@query("""WITH e AS (SELECT user_id, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 4.0 AS y FROM events),
i AS (SELECT user_id, n, (n % 97)::DOUBLE AS x, y FROM e WHERE n % 5 <> 0), b AS (SELECT user_id, (n % 90)::DOUBLE AS x0, y - 6 AS y0, CASE WHEN n % 15 = 0 THEN 200.0 ELSE n % 90 + 30 END AS x1, y + 30 AS y1 FROM e WHERE n % 5 = 0),
h AS (SELECT i.*, x0, x1 > 105 OR y1 > 605 AS beyond FROM i JOIN b ON i.user_id = b.user_id AND x + 2 BETWEEN x0 - 1 AND x1 + 1 AND i.y BETWEEN y0 - 1 AND y1 + 1)
SELECT n FROM i WHERE n % 8 = 0 OR n NOT IN (SELECT n FROM h WHERE NOT (beyond AND x < x0 - 1))""")
def q_prose_items(spark, sf_dir):
    """Every line is one item; every fifth is a box instead, and every third box reaches beyond its page. Every eighth line is in the contents."""
    n = F.col("n")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("n"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 4.0).alias("y"))
    d = lambda c: c.cast("double")
    items = rows.filter(n % 5 != 0).select("user_id", "n", d(n % 97).alias("x"), d(F.col("y")).alias("y"), F.lit(4.0).alias("width"), F.lit(5.0).alias("height"), F.when(n % 4 == 0, F.concat(F.lit("3.7 Title of "), n.cast("string"), F.lit(" lines"))).otherwise("words").alias("text"), F.lit(100.0).alias("page_width"), F.lit(600.0).alias("page_height"))
    boxes = rows.filter(n % 5 == 0).select("user_id", d(n % 90).alias("x0"), d(F.col("y") - 6).alias("y0"), d(F.when(n % 15 == 0, 200).otherwise(n % 90 + 30)).alias("x1"), d(F.col("y") + 30).alias("y1"))
    entries = rows.filter(n % 8 == 0).select("user_id", F.lit("3.7").alias("number"), F.concat(F.lit("Title of "), n.cast("string"), F.lit(" lines")).alias("title"))
    return layout.prose_items(items, boxes, entries, ["user_id"], ["user_id"]).select("n")
