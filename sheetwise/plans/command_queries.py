"""Queries of instruction tables: orders are tables made of cells, line items their rows; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import commands
from sheetwise.operators.cuts import dealt
from sheetwise.plans.text_queries import table

QUERIES, ORACLES = {}, {}
BY = ["o_custkey", "o_orderkey"]
#: (role, label, x0, x1) of the made tables' columns; Interface has two columns below it.
COLUMNS = (("command", "Command Name", 0, 100), ("opcode", "Opcode(2)", 100, 150), ("mode", "Interface SDR", 150, 175), ("mode", "Interface DDR", 175, 200), ("address", "Address", 200, 250), ("dummy", "Dummy", 250, 300), ("data", "Data", 300, 350), ("extra", "Max", 350, 400))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_lines(spark, sf_dir, orders):
    """Orders with their line items, one for each number: (n, k, place), k the smallest part. Line items move once, by order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").repartition("o_orderkey")
    numbered = lines.groupBy("o_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("k"))
    listed = numbered.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("_lines"))
    placed = F.transform("_lines", lambda line, i: F.struct(line["n"].alias("n"), line["k"].alias("k"), (i + 1).alias("place")))
    return orders.join(dealt(listed), "o_orderkey", "left").withColumn("lines", F.coalesce(placed, F.array().cast("array<struct<n:int,k:bigint,place:int>>"))).drop("_lines")


LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def made_cells(spark, sf_dir):
    """Cells of the tables: two header rows, then a row for each line item. What a row is follows from its number."""
    orders = table(spark, sf_dir, "orders").select(*BY, F.concat(F.lit("3."), F.col("o_orderkey").cast("string")).alias("section"), F.col("o_custkey").cast("int").alias("page"))
    cell = lambda x0, y0, x1, y1, text: F.struct(*[(v if not isinstance(v, (int, float)) else F.lit(float(v))).cast("double").alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    lacks = F.col("o_orderkey") % 3 == 0  # every third table names no instructions
    heads = [cell(a, 0, b, 20, label if role != "command" else F.when(lacks, "Register").otherwise(label)) for role, label, a, b in COLUMNS if role != "mode"]
    heads += [cell(150, 0, 200, 10, "Interface"), cell(150, 10, 175, 20, "SDR"), cell(175, 10, 200, 20, "DDR")]

    def row(line):
        n, k, key = line["n"], line["k"], line["k"].cast("string")
        y0, y1 = 10 + 10 * line["place"], 20 + 10 * line["place"]
        hexes = F.lower(F.lpad(F.hex(k % 256), 2, "0"))
        texts = {
            "command": F.when(n % 2 == 1, "Wrap M7-M0").when(n == 6, "Number of Clock (IO 1-1-4)").otherwise(F.concat(F.lit("Read "), key)),
            "opcode": F.when(n % 2 == 1, "0 1").when(n == 6, "").otherwise(F.concat(hexes, F.lit("H (3)"))),
            "Interface SDR": F.when(k % 2 == 0, "1-1-1").otherwise("-"), "Interface DDR": F.when(k % 3 == 0, "4-4-4").otherwise(""),
            "address": F.concat(F.lit("A"), key), "dummy": F.lit("8 (Def.)"), "data": F.lit(" D0 "), "extra": F.when(n == 6, "MHz").otherwise(key)}
        return F.when(n == 1, F.array(cell(0, y0, 400, y1, F.concat(F.lit("Group "), key)))).otherwise(F.array(*[cell(a, y0, b, y1, texts[label if role == "mode" else role]) for role, label, a, b in COLUMNS]))

    whole = with_lines(spark, sf_dir, orders).repartition("o_custkey")  # a document's tables lie together before they are cells
    return whole.select(*BY, "section", "page", F.explode(F.concat(F.array(*heads), F.flatten(F.transform("lines", row)))).alias("c")).select(*BY, "section", "page", "c.*")


@query("""SELECT o_custkey, o_orderkey, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'extra' ELSE 'command' END, 'opcode', 'mode', 'mode', 'address', 'dummy', 'data', 'extra']) AS role,
  unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'Register' ELSE 'Command Name' END, 'Opcode(2)', 'Interface SDR', 'Interface DDR', 'Address', 'Dummy', 'Data', 'Max']) AS label, unnest([0, 100, 150, 175, 200, 250, 300, 350])::DOUBLE AS x0 FROM orders""")
def q_header_columns(spark, sf_dir):
    return commands.header_columns(made_cells(spark, sf_dir), BY).select(*BY, "role", "label", "x0")


@query("""SELECT o_custkey, o_orderkey, false AS bytewise FROM orders WHERE o_orderkey % 3 <> 0""")
def q_command_tables(spark, sf_dir):
    return commands.command_tables(made_cells(spark, sf_dir), BY)


@query(f"""WITH l AS (SELECT o_custkey, l_orderkey AS o_orderkey, l_linenumber AS n, place, l_partkey AS k, '3.' || l_orderkey AS section, o_custkey::INT AS page FROM {LINES} JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 <> 0),
c AS (SELECT *, CASE WHEN n IN (2, 4) THEN upper(lpad(lower(hex(k % 256)), 2, '0')) || 'h' END AS own FROM l),
p AS (SELECT *, coalesce(n IN (2, 4) AND regexp_matches(k::VARCHAR, '^[01]{{2,4}}$') AND own = last_value(own IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS variant FROM c),
s AS (SELECT *, last_value(CASE WHEN n = 1 THEN 'Group ' || k END IGNORE NULLS) OVER w AS grp, count(*) FILTER (WHERE n = 6) OVER w > 0 AS clocked,
  last_value(CASE WHEN NOT variant AND own IS NOT NULL THEN 'Read ' || k END IGNORE NULLS) OVER w AS main, last_value(own IGNORE NULLS) OVER w AS code
  FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey, n ROWS UNBOUNDED PRECEDING))
SELECT o_custkey, o_orderkey, (10 + 10 * place)::DOUBLE AS top, coalesce(main, 'Wrap M7-M0') AS command, coalesce(code, '0 1') AS opcode,
  coalesce(nullif(concat_ws('；', CASE WHEN k % 2 = 0 THEN '1-1-1（SDR）' END, CASE WHEN k % 3 = 0 THEN '4-4-4（DDR）' END), ''), CASE WHEN clocked THEN '1-1-4' ELSE '' END) AS mode,
  'A' || k AS address, '8' AS dummy, 'D0' AS data, 'Max' || CASE WHEN clocked THEN ' (MHz)' ELSE '' END || ': ' || k AS extra, CASE WHEN variant THEN 'Read = ' || k WHEN n % 2 = 1 AND main IS NOT NULL THEN 'Wrap = 01' ELSE '' END AS setting, coalesce(grp, '') AS "group", section, page, CASE WHEN main IS NULL THEN '指令表列未辨識到 opcode，請核對原文。' END AS reason
FROM s WHERE n IN (2, 3, 4, 5, 7)""")
def q_command_table(spark, sf_dir):
    tables = commands.gathered(made_cells(spark, sf_dir), BY, ("section", "page"))
    return commands.command_rows(tables.filter(commands.holds_commands(F.col("cells")).isNotNull()), BY[:1], BY[1:]).drop("words")


def byte_cells(spark, sf_dir):
    """Byte-wise tables: a corner with a protocol in every other one, clocks in the third row, then a row for each line item."""
    orders = table(spark, sf_dir, "orders").select(*BY, F.lit("s").alias("section"), F.lit(1).alias("page"))
    cell = lambda x0, y0, x1, y1, text: F.struct(*[(v if not isinstance(v, (int, float)) else F.lit(float(v))).cast("double").alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    corner = F.when(F.col("o_orderkey") % 2 == 0, "Data Input Output I/O PROTOCOL (1 – 4 – 4)").otherwise("Data Input/Output")
    marks = (("Byte 1", 100, 150), ("Byte 2 ~ 4", 150, 200), ("Byte 5", 200, 250), ("Byte 6", 250, 300))
    heads = [cell(0, 0, 100, 10, corner), *[cell(a, 0, b, 10, label) for label, a, b in marks], cell(0, 10, 100, 20, "Number of Clock (1-1-1)"), *[cell(a, 10, b, 20, str(n)) for n, (_, a, b) in zip((8, 24, 8, 16), marks)]]

    def row(line):
        n, k, y0, y1 = line["n"], line["k"], 10 + 10 * line["place"], 20 + 10 * line["place"]
        code = F.when(n % 5 == 0, "none").otherwise(F.concat(F.lower(F.lpad(F.hex(k % 256), 2, "0")), F.lit("H")))
        return F.array(cell(0, y0, 100, y1, F.concat(F.lit("Fast Read (2) "), k.cast("string"))), cell(100, y0, 150, y1, code), cell(150, y0, 200, y1, "A23–A0"), cell(200, y0, 250, y1, "Dummy (Def)"), cell(250, y0, 300, y1, F.concat(F.lit("D"), k.cast("string"))))

    whole = with_lines(spark, sf_dir, orders)
    return whole.select(*BY, "section", "page", F.explode(F.concat(F.array(*heads), F.flatten(F.transform("lines", row)))).alias("c")).select(*BY, "section", "page", "c.*")


@query(f"""SELECT o_custkey, o_orderkey, (10 + 10 * place)::DOUBLE AS top, 'Fast Read ' || l_partkey AS command, CASE WHEN l_linenumber % 5 = 0 THEN 'none' ELSE lpad(hex(l_partkey % 256), 2, '0') || 'h' END AS opcode,
  CASE WHEN o_orderkey % 2 = 0 THEN '1-4-4' ELSE '1-1-1' END AS mode, 'A23–A0' AS address, 'Byte 5: 8 clocks (Dummy )' AS dummy, 'Byte 6: D' || l_partkey AS data,
  'Fast Read (2) ' || l_partkey || '; Byte 2 ~ 4: A23–A0 [24 clocks]; Byte 5: Dummy (Def) [8 clocks]; Byte 6: D' || l_partkey || ' [16 clocks]' AS extra, '' AS setting, '' AS "group", CASE WHEN l_linenumber % 5 = 0 THEN '指令表列未辨識到 opcode，請核對原文。' END AS reason
FROM {LINES} JOIN orders ON l_orderkey = o_orderkey""")
def q_byte_command_table(spark, sf_dir):
    tables = commands.gathered(byte_cells(spark, sf_dir), BY, ("section", "page"))
    return commands.byte_command_rows(tables.filter(commands.holds_commands(F.col("cells"))), BY[:1], BY[1:]).drop("words", "section", "page")
