"""Queries of the page-level operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import documents as doc
from sheetwise.plans.text_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, (p_size || '.' || (p_partkey % 9)) AS number, p_name AS title FROM part WHERE p_partkey % 4 <> 0")
def q_toc_entries(spark, sf_dir):
    line = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.lit(" "), F.col("p_name"), F.lit(" ........ "), F.col("p_partkey").cast("string")))
    return doc.toc_entries(table(spark, sf_dir, "part").select("p_partkey", line.alias("text"))).select("p_partkey", "number", "title")


@query("""WITH l AS (SELECT event_id, user_id, event_id % 100 AS y, CASE WHEN event_id % 3 = 0 THEN 'Page ' || event_id || ' of ' || event_type ELSE 'line ' || event_type END AS text FROM events),
f AS (SELECT DISTINCT user_id, regexp_replace(regexp_replace(text, ' ', '', 'g'), '\\d+', '#', 'g') AS k FROM l WHERE y >= 92)
SELECT event_id FROM l WHERE y > 9 AND y < 92 AND NOT (y > 80 AND EXISTS (SELECT 1 FROM f WHERE f.user_id = l.user_id AND f.k = regexp_replace(regexp_replace(l.text, ' ', '', 'g'), '\\d+', '#', 'g')))""")
def q_learned_footer(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Page "), F.col("event_id").cast("string"), F.lit(" of "), F.col("event_type"))).otherwise(F.concat(F.lit("line "), F.col("event_type")))
    lines = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 100).alias("y"), F.lit(100).alias("height"), text.alias("text"))
    return doc.without_footers(lines, ["user_id"], "y", "height").select("event_id")


@query("""SELECT o_orderkey, (SELECT min(event_id) FROM events e WHERE e.user_id = o.o_custkey AND e.event_id >= o.o_orderkey) AS note_page FROM orders o""")
def q_notes_as_of(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    notes = table(spark, sf_dir, "events").select("user_id", "event_id")
    return doc.notes_for(rows, notes, ["user_id"], "o_orderkey", "event_id").select("o_orderkey", "note_page")


@query("""SELECT s_nationkey, 'AB25Q' || s_suppkey || 'ZZ' AS product, array_to_string([s_suppkey], ',') AS pages FROM supplier WHERE s_suppkey > 2 AND length('AB25Q' || s_suppkey || 'ZZ') >= 6""")
def q_strange_products(spark, sf_dir):
    pages = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("AB25Q"), F.col("s_suppkey").cast("string"), F.lit("ZZ-DTR")).alias("header"))
    known = doc.catalogue(pages.withColumn("text", F.lit("")), ["s_nationkey"], "header", "text", "s_suppkey")
    return doc.strangers(pages, known, ["s_nationkey"], "header", "s_suppkey").select("s_nationkey", "product", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("""WITH t AS (SELECT *, max((p_size > 48)::INT) OVER w AS a, max((p_size > 40)::INT) OVER w AS b FROM part WINDOW w AS (PARTITION BY p_name))
SELECT p_partkey FROM t WHERE CASE WHEN a = 1 THEN p_size > 48 WHEN b = 1 THEN p_size > 40 ELSE p_size > 30 END""")
def q_page_tiers(spark, sf_dir):
    size = F.col("p_size")
    return doc.chosen_pages(table(spark, sf_dir, "part"), ["p_name"], size > 48, size > 40, size > 30).select("p_partkey")


@query("""SELECT c_custkey, 'Note: x; Any Address (MHz): fast' AS rest, unnest(['Aligned', 'Any']) AS start, unnest([133.0, c_nationkey + 0.5])::DOUBLE AS lim, unnest(['', '(typ)']) AS qualifier FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'only text', NULL, NULL, NULL FROM customer WHERE c_custkey % 2 = 1""")
def q_command_limits(spark, sf_dir):
    extra = F.when(F.col("c_custkey") % 2 == 1, "only text").otherwise(F.concat(F.lit("Aligned Address (MHz): 133 (2); Note: x; any address ( MHz ): "), F.col("c_nationkey").cast("string"), F.lit(".5 (typ); Any Address (MHz): fast")))
    return doc.command_limits(table(spark, sf_dir, "customer").select("c_custkey", extra.alias("extra"))).select("c_custkey", "rest", "start", F.col("limit").alias("lim"), "qualifier")


@query("""SELECT event_id, unnest(['1-1-1（SDR）', '8d-8d-8d（ODDR）']) AS mode, unnest(['SDR', 'DDR']) AS rate FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_type <> 'view'""")
def q_mode_variants(spark, sf_dir):
    mode = F.when(F.col("event_type") == "view", "1-1-1（SDR）；8d-8d-8d（ODDR）").otherwise(F.col("event_type"))
    return doc.mode_variants(table(spark, sf_dir, "events").select("event_id", mode.alias("mode")))


@query()
def q_reflow(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"(?<=\w)\s(?=\w{6})")).alias("ord", "text"))
    return doc.reflow(lines.withColumns({"kind": F.lit("text"), "page": (F.col("ord") / 3).cast("int")}), ["item_id"], "ord")
