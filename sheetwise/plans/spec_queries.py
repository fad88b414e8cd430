"""Queries of specification rows, frequency matrices and read groups over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import compare, consolidate, reads, specs, tables
from sheetwise.plans.text_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, 'AB25Q' || p_size || 'RW' AS product, 'tCLQV' || p_size AS symbol, p_name AS parameter, CASE WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR ELSE 'open' END AS max, '1250' AS typ, '-3' AS min, 'ns' AS unit,
  'fast' || CASE WHEN p_partkey % 2 = 0 THEN '; Starting Address: aligned' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '; Factory Mode' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '; Operating Temperature -40 to 85' ELSE '' END AS condition,
  CASE WHEN p_partkey % 2 = 0 THEN 'Aligned' END AS start, 'Note 4' || CASE WHEN p_partkey % 4 = 0 THEN '; max: Note 2; max: Note 3' ELSE '' END || '; min: Note 1' || CASE WHEN p_partkey % 7 = 0 THEN '; Alternate symbol: ' || p_brand ELSE '' END AS description, 'AC' AS spec_type FROM part""")
def q_spec_rows(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    model = F.concat(F.lit("AB25Q"), size, F.lit("RW"))
    section = F.concat(F.lit("8.3 AC "), F.when(n % 3 == 0, "(Factory Mode) ").otherwise(""), F.when(n % 5 == 0, "| Operating Temperature -40 to 85 | x").otherwise(""))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", model.alias("product"), F.concat(F.lit("t CLQV (4) "), size).alias("symbol"), F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("parameter"), F.concat(model, F.lit("-DTR, fast"), F.when(n % 2 == 0, "; Starting Address: aligned").otherwise("")).alias("condition"),
        F.when(n % 4 == 0, F.concat(size, F.lit(" (2)(3)"))).otherwise("open").alias("max"), F.lit("1,250").alias("typ"), F.lit("− 3 (1)").alias("min"), F.lit(" ns").alias("unit"), F.when(n % 7 == 0, F.col("p_brand")).alias("alternate"),
        F.array(model).alias("products"), F.lit("AC").alias("kind"), section.alias("section"))
    return specs.made_rows(rows).drop("section")


#: A matrix for each customer: two address widths, three alignment columns under two instructions, a row for each clock count.
@query("""WITH a AS (SELECT unnest([0, 1, 2]) AS k, unnest(['Aligned', 'Any', 'Aligned']) AS start, unnest(['Read', 'Read', 'Fast Read']) AS head), w AS (SELECT unnest([0, 1]) AS w, unnest(['3-byte', '4-byte']) AS address)
SELECT c_custkey, head || ' maximum clock frequency' AS parameter, address, upper(lpad(hex((c_custkey + 16 * k + w) % 256), 2, '0')) || 'h' AS opcode, (4 + 2 * r)::VARCHAR AS dummy, start, CASE WHEN (c_custkey + r + k) % 4 = 0 OR c_custkey + r = 200 THEN 'DS bit enabled' END AS extra,
  CASE WHEN (c_custkey + r + k) % 4 = 0 THEN '200' ELSE (c_custkey + r)::VARCHAR END AS max, CASE WHEN (c_custkey + r + k) % 4 = 0 THEN 'max: Note 2; ' ELSE '' END || 'Frequency matrix; symbol not specified in source' AS description
FROM customer, a, w, (SELECT unnest([0, 1, 2]) AS r) WHERE (c_custkey + k + w) % 5 <> 0 AND (c_custkey + r * k) % 7 <> 6""")
def q_frequency_matrix(spark, sf_dir):
    n = F.col("c_custkey")
    cell = lambda x0, y0, x1, y1, text: F.struct(*[F.lit(float(v)).alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    made = [cell(0, 0, 100, 10, "Address Mode"), cell(100, 0, 200, 10, "Read"), cell(200, 0, 250, 10, "Fast Read"), cell(0, 10, 100, 20, "3-byte"), cell(0, 20, 100, 30, "4-byte"), cell(0, 30, 100, 40, "Dummy")]
    for k, start in enumerate(("Aligned", "Any", "Aligned")):
        made.append(cell(100 + 50 * k, 30, 150 + 50 * k, 40, start))
        for w in (0, 1):
            made.append(cell(100 + 50 * k, 10 + 10 * w, 150 + 50 * k, 20 + 10 * w, F.when((n + k + w) % 5 == 0, "X").otherwise(F.concat(F.lower(F.lpad(F.hex((n + 16 * k + w) % 256), 2, "0")), F.lit("H")))))
        for r in range(3):
            limit = F.when((n + r * k) % 7 == 6, "-").when((n + r + k) % 4 == 0, "200(2)").otherwise((n + r).cast("string"))
            made.append(cell(100 + 50 * k, 40 + 10 * r, 150 + 50 * k, 50 + 10 * r, limit))
    made += [cell(0, 40 + 10 * r, 100, 50 + 10 * r, f"{4 + 2 * r}(1)") for r in range(3)]
    customers = table(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")  # dealt before they are cells
    cells = customers.select("c_custkey", F.explode(F.array(*made)).alias("c")).select("c_custkey", "c.*")
    return specs.frequency_rows(cells, ["c_custkey"])


GROUP = """CASE p_partkey % 6 WHEN 0 THEN 'Clock frequency for Read Data with 8 dummy' WHEN 1 THEN 'Clock frequency except Read Data and DTR' WHEN 2 THEN 'Clock frequency, DTR instructions'
 WHEN 3 THEN 'Clock frequency, Read Data instruction (03h)' WHEN 4 THEN 'Clock frequency' ELSE 'Frequency, DTR instructions' END"""


@query(f"""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CASE p_partkey % 6 WHEN 0 THEN 'dummy' WHEN 1 THEN 'except' WHEN 2 THEN 'dtr' WHEN 3 THEN 'read-data' END END AS kind FROM part""")
def q_read_kinds(spark, sf_dir):
    size = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", specs.read_group(F.when(size == 1, "AC").when(size == 2, "AC").otherwise("DC"), F.lit("MHz"), F.expr(GROUP.replace("\n", " "))).alias("kind"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SPI' ELSE 'QPI' END AS mode, o_orderkey % 9 AS code FROM orders),
s AS (SELECT DISTINCT o_custkey, 'P0-P1 = ' || l_linenumber AS setting, CASE WHEN l_partkey % 2 = 0 THEN 'SPI' ELSE 'QPI' END AS mode, l_partkey % 9 AS a, l_partkey % 4 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT DISTINCT c.o_orderkey, setting FROM c JOIN s ON c.o_custkey = s.o_custkey AND c.mode = s.mode AND (code = a OR code = b)""")
def q_settings_of(spark, sf_dir):
    hexed = lambda c: F.concat(F.lit("0"), c.cast("string"), F.lit("h"))
    orders = table(spark, sf_dir, "orders")
    found = orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "1-1-1").otherwise("4-4-4").alias("mode"), F.lit("s").alias("section"), hexed(F.col("o_orderkey") % 9).alias("opcode"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    sets = lines.select("o_custkey", F.concat(F.lit("P0-P1 = "), F.col("l_linenumber").cast("string")).alias("setting"), F.when(F.col("l_partkey") % 2 == 0, "SPI").otherwise("QPI").alias("mode"), F.array(hexed(F.col("l_partkey") % 9), hexed(F.col("l_partkey") % 4)).alias("codes")).distinct()
    return specs.settings_of(found, sets, ["o_custkey"]).select("o_orderkey", F.col("set_setting").alias("setting")).distinct()


@query("""SELECT l_orderkey, l_linenumber::VARCHAR AS setting, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN '原始設定表重複 ' || l_linenumber || '，請核對；未推定缺少的設定。' END AS conflict FROM lineitem""")
def q_repeated_settings(spark, sf_dir):
    return specs.repeated_settings(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("setting")), ["l_orderkey"])


#: Groups of a customer's document: parts of five kinds for two products; instructions are its orders.
@query("""WITH g AS (SELECT c_custkey AS doc, 'P' || p AS product, k, ['Clock frequency for Read Data with 8 dummy', 'Clock frequency except Read Data and DTR', 'Clock frequency, DTR instructions', 'Clock frequency, Read Data instruction (03h)'][k] AS parameter FROM customer, (SELECT unnest([1, 2]) AS p), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE (c_custkey + p + k) % 3 <> 0),
c AS (SELECT o_custkey AS doc, o_orderkey, o_orderkey % 4 AS m, o_orderkey % 5 AS code, CASE WHEN o_orderkey % 3 = 0 THEN 8 END AS dummy, o_orderkey % 7 = 0 AS named FROM orders),
r AS (SELECT c.doc, o_orderkey, product, parameter, k, CASE WHEN m = 3 THEN CASE WHEN k = 3 THEN 0 END WHEN named AND k = 2 THEN 1 WHEN k = 1 AND dummy = 8 THEN 2
  WHEN k = CASE WHEN code = 3 AND EXISTS (SELECT 1 FROM g b WHERE b.doc = c.doc AND b.k = 4) THEN 4 ELSE 2 END THEN 3 END AS rank FROM c JOIN g ON c.doc = g.doc)
SELECT doc, o_orderkey, product, arg_min(parameter, rank * 10 + k) AS "group", min(rank)::INT AS rank FROM r WHERE rank IS NOT NULL GROUP BY ALL""")
def q_read_groups(spark, sf_dir):
    names = ("Clock frequency for Read Data with 8 dummy", "Clock frequency except Read Data and DTR", "Clock frequency, DTR instructions", "Clock frequency, Read Data instruction (03h)")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("p")).select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ord")).filter((F.col("doc") + F.col("p") + F.col("ord")) % 3 != 0)
    parameter = F.element_at(F.array(*map(F.lit, names)), F.col("ord"))
    groups = customers.select("doc", F.concat(F.lit("P"), F.col("p").cast("string")).alias("product"), "ord", parameter.alias("parameter"), F.when(F.col("ord") == 2, "fR").otherwise("fC").alias("symbol"), specs.read_group(F.lit("AC"), F.lit("MHz"), parameter).alias("kind"))
    n = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.when(n % 7 == 0, "Burst Read").otherwise("Fast Read").alias("command"), F.concat(F.lit("0"), (n % 5).cast("string"), F.lit("h")).alias("opcode"),
                                                  F.when(n % 4 == 3, "1-1d-1d").otherwise("1-1-1").alias("mode"), F.lit("s").alias("section"), F.when(n % 3 == 0, 8).alias("dummy"))
    pages = customers.select("doc").distinct().withColumns({"page": F.lit(3), "text": F.lit("x. The Burst Read instruction allows clock rates from D.C. to a maximum of f R (AC).")})
    return specs.group_of(found, groups, specs.references(pages, ["doc"]), ["doc"], "o_orderkey").select("doc", "o_orderkey", "product", "group", "rank")


@query("""WITH g AS (SELECT unnest(['P1', 'P1', 'P1', 'P2']) AS product, unnest([1, 2, 3, 2]) AS k, unnest(['SDR', 'SDR', 'DDR', 'SDR']) AS rate, unnest(['Clock frequency for Read (03h/0Bh)', 'Clock frequency except for Read', 'Clock frequency except for Read', 'Clock frequency except for Read']) AS parameter),
c AS (SELECT o_orderkey, o_orderkey % 4 AS m, o_orderkey % 5 = 3 AS listed FROM orders), v AS (SELECT o_orderkey, listed, '1-1-8（SDR）' AS protocol, 'SDR' AS rate FROM c WHERE m < 2 UNION ALL SELECT o_orderkey, listed, '8d-8d-8d', 'DDR' FROM c WHERE m > 0 UNION ALL SELECT o_orderkey, listed, '2-2-2', NULL FROM c WHERE m = 3),
h AS (SELECT o_orderkey, product, protocol, v.rate, parameter AS "group" FROM v JOIN g ON v.rate = g.rate AND CASE WHEN k = 1 THEN listed ELSE NOT listed OR product = 'P2' END)
SELECT * FROM h UNION ALL SELECT o_orderkey, p.product, protocol, rate, NULL FROM v, (SELECT unnest(['P1', 'P2']) AS product) p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.o_orderkey = v.o_orderkey AND h.product = p.product AND h.protocol = v.protocol)""")
def q_octal_modes(spark, sf_dir):
    n = F.col("o_orderkey")
    mode = F.concat_ws("；", F.when(n % 4 < 2, "1-1-8（SDR）"), F.when(n % 4 > 0, " 8d-8d-8d"), F.when(n % 4 == 3, "2-2-2"))
    found = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), "o_orderkey", F.concat(F.lit("0"), (n % 5).cast("string"), F.lit("h")).alias("opcode"), mode.alias("mode"))
    rows = [(1, "P1", "SDR", "Clock frequency for Read (03h/0Bh)"), (1, "P1", "SDR", "Clock frequency except for Read"), (1, "P1", "ODDR", "Clock frequency except for Read"), (1, "P2", "SDR", "Clock frequency except for Read")]
    groups = spark.createDataFrame(rows, "doc int, product string, rate string, parameter string")
    return specs.octal_modes(found, groups, ["doc"], "o_orderkey").select("o_orderkey", "product", "protocol", "rate", "group")


@query("""WITH r AS (SELECT l_orderkey % 50 AS doc, (l_orderkey * 10 + l_linenumber) * 5 + l_partkey % 5 AS row_id, l_partkey % 5 AS k FROM lineitem GROUP BY ALL), c AS (SELECT o_orderkey % 50 AS doc, min(o_orderkey) AS o, o_orderkey % 4 AS m FROM orders GROUP BY ALL),
n AS (SELECT doc, o, ['02h', 'D8h', 'C7h', '20h'][m + 1] AS code, ['Page Program', '64KB Block Erase', 'Chip Erase', 'Sector Erase'][m + 1] AS name FROM c),
h AS (SELECT DISTINCT row_id, o, code, name, CASE WHEN k = 1 THEN '原文標示 opcode' ELSE '名稱規則對應' END AS basis FROM r JOIN n ON r.doc = n.doc AND CASE k WHEN 0 THEN name = 'Page Program' WHEN 1 THEN code IN ('20h', 'D8h') WHEN 2 THEN name = 'Chip Erase' END)
SELECT r.row_id, CASE WHEN k = 1 THEN coalesce(t, '20h, D8h') ELSE t END AS commands, CASE WHEN k = 1 THEN '原文標示 opcode' ELSE basis END AS basis FROM r LEFT JOIN (SELECT row_id, string_agg(code || ' ' || name || '（SPI）', '；' ORDER BY o) AS t, min(basis) AS basis FROM h GROUP BY row_id) s ON r.row_id = s.row_id""")
def q_linked_commands(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 5 + F.col("l_partkey") % 5).alias("row_id"), (F.col("l_partkey") % 5).alias("k")).distinct()
    text = F.when(F.col("k") == 0, "Page Program Time").when(F.col("k") == 1, "Erase time (20h / d8H)").when(F.col("k") == 2, "Chip Erase Time").otherwise("Other")
    found = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("doc"), (F.col("o_orderkey") % 4).alias("m")).agg(F.min("o_orderkey").alias("command_id"))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("m") + 1).cast("int"))
    commands = found.select("doc", "command_id", pick("02h", "D8h", "C7h", "20h").alias("opcode"), pick("Page Program", "64KB Block Erase", "Chip Erase", "Sector Erase").alias("command"), F.lit("SPI").alias("mode"), F.lit("").alias("setting"))
    variants = commands.withColumns({"setting": F.lit("P = 01"), "command_id": F.col("command_id") + 1})
    return consolidate.linked_commands(lines.select("doc", "row_id", text.alias("parameter")), commands.unionByName(variants), ["doc"], "row_id").select("row_id", "commands", "basis")


@query("""WITH s AS (SELECT min(o_orderkey) AS id, o_custkey % 20 AS doc, o_custkey % 3 AS a, o_orderkey % 5 AS code, o_orderkey % 2 AS io, min(o_orderkey % 7) AS max FROM orders GROUP BY ALL),
c AS (SELECT DISTINCT (((l_partkey % 20) * 3 + l_partkey % 3) * 5 + l_linenumber % 5) * 7 + l_orderkey % 7 AS id, l_partkey % 20 AS doc, l_partkey % 3 AS a, l_linenumber % 5 AS code, l_orderkey % 7 AS max FROM lineitem WHERE l_linenumber > 1),
m AS (SELECT c.id, c.max, s.id AS spec_id, s.max AS spec_max FROM c JOIN s ON c.doc = s.doc AND c.a = s.a AND c.code IN (s.code, 9 - s.code) AND s.io = 0),
j AS (SELECT id, count(*) AS n, min(spec_id) AS spec_id, min(spec_max) AS spec_max, max(max) AS max FROM m GROUP BY id)
SELECT c.id, CASE WHEN n IS NULL THEN 'kept' WHEN n = 1 AND spec_max = j.max THEN 'absorbed' ELSE 'conflict' END AS outcome, CASE WHEN n = 1 AND spec_max = j.max THEN spec_id END AS spec_id,
  CASE WHEN n > 1 THEN '相同指令與條件對應到多筆 AC 頻率，未自動合併。' WHEN n = 1 AND spec_max <> j.max THEN '相同指令與條件的頻率不一致：AC ' || spec_max || ' MHz、指令表 ' || j.max || ' MHz，未自動合併。' END AS reason FROM c LEFT JOIN j ON c.id = j.id""")
def q_frequency_scope(spark, sf_dir):
    n = F.col("o_orderkey")
    code = lambda c: F.concat(F.lit("0"), c.cast("string"), F.lit("h"))
    same = {"mode": F.lit("SPI"), "section": F.lit("s"), "dummy": F.lit("8 (Def)"), "start": F.lit("Any"), "condition": F.lit("opcode=xx; VCC = 3V; Starting Address: Any")}
    width = lambda c: F.element_at(F.array(*map(F.lit, ("A23–A0", "4-byte Address", "A31/A23-A0"))), (c + 1).cast("int"))
    spec = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("doc"), (F.col("o_custkey") % 3).alias("a"), (n % 5).alias("code"), (n % 2).alias("io")).agg(F.min("o_orderkey").alias("id"), F.min(n % 7).alias("max"))
    spec = spec.select("doc", "id", "max", F.lit("P").alias("product"), F.concat_ws("/", code(F.col("code")), code(9 - F.col("code"))).alias("opcode"), width(F.col("a")).alias("address"), F.when(F.col("io") == 1, "4-4-4").alias("io"), F.lit("Fast Read/Read I / O maximum clock frequency").alias("parameter")).withColumns(same)
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").groupBy((F.col("l_partkey") % 20).alias("doc"), (F.col("l_partkey") % 3).alias("a"), (F.col("l_linenumber") % 5).alias("code"), (F.col("l_orderkey") % 7).alias("max")).count().withColumn("id", ((F.col("doc") * 3 + F.col("a")) * 5 + F.col("code")) * 7 + F.col("max")).drop("count")
    width_of = lambda c: F.element_at(F.array(*map(F.lit, ("3", "A31-A0", "3-/4-byte"))), (c + 1).cast("int"))
    found = lines.select("doc", "id", "max", F.lit("P").alias("product"), code(F.col("code")).alias("opcode"), width_of(F.col("a")).alias("address"), F.lit("1-1-1").alias("io"), F.lit("Read IO with 4-Byte Address").alias("parameter"), F.lit("").alias("setting")).withColumns(same | {"dummy": F.lit("8"), "mode": F.lit("1-1-1")})
    out, _ = consolidate.frequency_outcomes(spec, found, ["doc"])
    return out.select("id", "outcome", "spec_id", "reason")


@query("""WITH k AS (SELECT s_suppkey, 10 + s_suppkey % 5 AS a FROM supplier),
r AS (SELECT s_suppkey, a, unnest([1, 2, 3, 4, 5, 6]) AS n FROM k), m AS (SELECT s_suppkey, a, n, unnest(CASE n WHEN 1 THEN [a] WHEN 2 THEN range(a, a + 3) WHEN 3 THEN [a, a + 2] WHEN 4 THEN range(a, a + 4) WHEN 6 THEN [a + 1] END) AS model FROM r WHERE n <> 5)
SELECT s_suppkey, 'AB25Q' || model || 'RW' AS product, 'fC' || n AS symbol, 'Clock ' || n AS parameter, CASE n WHEN 6 THEN 'fast' ELSE 'VCC' END AS condition, CASE n WHEN 2 THEN n::VARCHAR ELSE '' END AS min, CASE n WHEN 2 THEN (a + n)::VARCHAR ELSE (a * n)::VARCHAR END AS max, NULL AS reason FROM m
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, 'the product isn''t in the catalogue' FROM k""")
def q_specification_table(spark, sf_dir):
    a = 10 + F.col("s_suppkey") % 5
    model = lambda shift: F.concat(F.lit("AB25Q"), (a + shift).cast("string"), F.lit("RW"))
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    scopes = (model(0), F.concat(model(0), F.lit("–"), model(2)), F.concat(F.lit("AB25Q"), a.cast("string"), F.lit("/"), (a + 2).cast("string"), F.lit("RW")), "All", F.concat(model(0), F.lit("-99ZZ")), "")
    head = ("Parameter", "Symbol", "Product", "Test Condition", "Min.", "Max", "Unit")
    body = [(f"Clock {n}", f"fC {n}", scope, F.concat(model(1), F.lit(", fast")) if n == 6 else "VCC", F.concat(F.lit(f"{n} to "), (a + n).cast("string")) if n == 2 else "", "" if n == 2 else (a * n).cast("string"), "MHz") for n, scope in enumerate(scopes, 1)]
    made = [F.struct(*[F.lit(float(v)).alias(k) for k, v in (("x0", 100 * x), ("y0", 25 * y), ("x1", 100 * x + 100), ("y1", 25 * y + 25))], text(c).alias("text")) for y, row in enumerate([head, *body]) for x, c in enumerate(row)]
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(*[model(k) for k in range(4)]).alias("products"), F.explode(F.array(*made)).alias("c")).select("s_suppkey", "products", "c.*")
    return tables.normalize_tables(cells, ["s_suppkey"]).select("s_suppkey", "product", "symbol", "parameter", "condition", "min", "max", "reason")


@query("""SELECT o_orderstatus, n.d::INT AS dummy, ['Aligned', 'Any'][s.k] AS start, max(o_orderkey)::DOUBLE AS max FROM orders, (SELECT unnest([0, 1, 2]) AS d) n, (SELECT unnest([1, 2]) AS k) s WHERE o_orderkey % 3 = n.d AND o_custkey % 2 = s.k - 1 AND NOT (n.d = 1 AND s.k = 2) GROUP BY ALL""")
def q_alignment_matrix(spark, sf_dir):
    body = table(spark, sf_dir, "orders").groupBy("o_orderstatus", (F.col("o_orderkey") % 3 + 1).cast("int").alias("row"), (F.col("o_custkey") % 2 + 1).cast("int").alias("col")).agg(F.max("o_orderkey").cast("string").alias("text"))
    body = body.withColumn("text", F.when((F.col("row") == 2) & (F.col("col") == 2), " x ").otherwise(F.col("text")))
    marks = body.select("o_orderstatus").distinct().select("o_orderstatus", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("text")) for r, c, v in ((0, 1, "Aligned"), (0, 2, "Any"), (1, 0, "0"), (2, 0, "1"), (3, 0, "2"))])).alias("m")).select("o_orderstatus", "m.*")
    return tables.unpivot_frequencies(body.unionByName(marks), ["o_orderstatus"])


@query("""WITH n AS (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part),
r AS (SELECT p_partkey, k, unnest(CASE WHEN k < 2 THEN ['Aligned', 'Any'] ELSE ['Aligned'] END) AS start, p_size AS new, p_size AS old FROM n),
d AS (SELECT p_partkey, k, start, new, CASE WHEN k = 1 AND start = 'Any' THEN old + 1 ELSE old END AS old FROM r),
e AS (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN new = old THEN 'unchanged' ELSE 'changed' END AS status FROM d)
SELECT p_partkey, CASE WHEN count(*) = 2 THEN 'Aligned/Any' ELSE min(start) END AS start, 'VCC; Starting Address: ' || CASE WHEN count(*) = 2 THEN 'Aligned/Any' ELSE min(start) END AS condition, status, coalesce(max(CASE WHEN status = 'changed' THEN 'max：' || old || ' → ' || new END), '') AS told FROM e GROUP BY p_partkey, status""")
def q_spec_compare(spark, sf_dir):
    n = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", (n % 4).alias("k"), "p_size")
    both = parts.withColumn("start", F.when(F.col("k") < 2, "Aligned/Any").otherwise("Aligned"))
    row = lambda df: df.select("p_partkey", F.col("p_partkey").alias("ord"), "start", F.concat(F.lit("VCC; Starting Address: "), "start").alias("condition"), F.lit("MHz").alias("unit"), F.col("p_size").alias("max"))
    split = parts.filter("k = 1").select("p_partkey", "k", F.explode(F.array(F.struct(F.lit("Aligned").alias("start"), F.lit(0).alias("add")), F.struct(F.lit("Any").alias("start"), F.lit(1).alias("add")))).alias("s"), "p_size")
    split = split.select("p_partkey", "k", (F.col("p_size") + F.col("s.add")).alias("p_size"), "s.start")
    old = both.filter("k <> 1").unionByName(split, allowMissingColumns=True).filter(n % 10 != 0)
    got = compare.compare_specs(row(both), row(old), ("p_partkey", "condition"), ("max", "unit"), "ord").rows
    return got.select("p_partkey", "start", "condition", "status", compare.change_text(F.col("changes")).alias("told"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 3 AS k FROM customer), r AS (SELECT c_custkey, k, unnest([0, 1, 2]) AS r FROM c)
SELECT c_custkey, (20 + 10 * r)::DOUBLE AS top, CASE WHEN k = 2 THEN ['EBh', '0Bh'] ELSE ['0Ch'] END AS codes, CASE k WHEN 1 THEN 'SPI_DTR' ELSE 'QPI' END AS mode, CASE WHEN r < 2 THEN 'P5-P4 = ' || r || '1' END AS setting, CASE WHEN r < 2 THEN (4 + 2 * r)::INT END AS dummy,
  CASE WHEN r < 2 THEN c_custkey + 0.5 END::DOUBLE AS max, CASE WHEN r < 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Aligned' ELSE '' END END AS start, CASE WHEN r = 2 THEN '無法可靠對應設定表的指令、模式或數值。' END AS reason FROM r""")
def q_read_settings(spark, sf_dir):
    n, k = F.col("c_custkey"), F.col("c_custkey") % 3
    cell = lambda x0, y0, x1, y1, text: F.struct(*[F.lit(float(v)).alias(c) for c, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], (text if not isinstance(text, str) else F.lit(text)).alias("text"))
    head = F.when(k == 1, "P5–P4 of SPI DTR (0Ch)").when(k == 2, "P5-P4 in QPI").otherwise("P5 P4 QPI 0Ch")
    made = [cell(0, 0, 100, 20, head), cell(100, 0, 180, 20, "DUMMY CLOCKS"), cell(180, 0, 300, 20, "Maximum Read Freq.")]
    for r, (setting, dummy) in enumerate((("0 1", "4 (2)"), ("11", "6 (default)"), ("111", "8"))):
        made += [cell(0, 20 + 10 * r, 100, 30 + 10 * r, setting), cell(100, 20 + 10 * r, 180, 30 + 10 * r, dummy), cell(180, 20 + 10 * r, 300, 30 + 10 * r, F.concat(n.cast("string"), F.lit(".5 MHz*")))]
    customers = table(spark, sf_dir, "customer")
    cells = customers.select("c_custkey", F.lit(1).alias("t"), F.explode(F.array(*made)).alias("c")).select("c_custkey", "t", "c.*")
    lines = customers.select("c_custkey", F.lit(70.0).alias("y"), F.when(n % 2 == 0, "Note: * with 4-Byte alignment").otherwise("Note: none").alias("text"))
    pages = customers.select("c_custkey", F.lit("x\n- QPI mode: only EBh\n QPI mode: Fast Read EBh, 0Bh").alias("text"))
    return specs.read_settings(cells, lines, pages, ["c_custkey"], ["t"]).drop("t", "note", "raw")


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 3 AS k, unnest(['P1', 'P2']) AS product FROM orders WHERE o_orderkey % 7 <> 0), l AS (SELECT *, unnest(CASE k WHEN 0 THEN [NULL] WHEN 1 THEN ['Aligned'] ELSE ['Aligned', 'Any'] END) AS start FROM c)
SELECT o_orderkey, product, 'Read ' || o_orderkey AS parameter, 'opcode=0Bh/0Ch; IO=1-1-4; P = 01' || CASE WHEN start = 'Any' THEN '; (typ)' ELSE '' END || CASE WHEN start IS NOT NULL THEN '; Starting Address: ' || start ELSE '' END AS condition,
  CASE start WHEN 'Aligned' THEN '133' WHEN 'Any' THEN (o_orderkey % 50) || '.5' ELSE '' END AS max, CASE WHEN start IS NULL THEN '' ELSE 'MHz' END AS unit, 'Data: D0; Note: x' AS description, 'Command' AS spec_type, start, '0Bh/0Ch' AS opcode, 'SPI_DTR' AS mode, '1-1-4' AS io, '8' AS dummy, '0Bh/0Ch Read ' || o_orderkey AS commands FROM l""")
def q_command_specs(spark, sf_dir):
    n = F.col("o_orderkey")
    extra = F.concat_ws("; ", F.when(n % 3 > 0, "Aligned Address (MHz): 133 (2)"), F.lit("Note: x"), F.when(n % 3 == 2, F.concat(F.lit("any address ( MHz ): "), (n % 50).cast("string"), F.lit(".5 (typ)"))))
    found = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), "o_orderkey", F.concat(F.lit("Read "), n.cast("string")).alias("command"), F.lit("0bh, 0CH").alias("opcode"), F.lit("1-1-4").alias("mode"), F.lit("P = 01").alias("setting"), F.lit("A23-A0").alias("address"),
                                                  F.lit("8 (Def)").alias("dummy"), F.lit("D0").alias("data"), extra.alias("extra"), F.when(n % 7 == 0, "Factory Mode").otherwise("g").alias("group"), F.lit("3.1 DTR reads").alias("section"))
    products = spark.createDataFrame([(1, ["P1", "P2"])], "doc int, products array<string>")
    got = specs.command_spec_rows(found, F.broadcast(products), ["doc"])  # one row, of one document: dealing by document would leave one task
    return got.withColumn("o_orderkey", F.regexp_extract("parameter", r"(\d+)", 1).cast("long")).select("o_orderkey", "product", "parameter", "condition", "max", "unit", "description", "spec_type", "start", "opcode", "mode", "io", "dummy", "commands")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 AS s, l_quantity::BIGINT % 2 AS q FROM lineitem), g AS (SELECT l_orderkey, s, q, min(l_linenumber * 1000000 + l_partkey) AS ord, CASE WHEN q = 1 THEN '' ELSE 's' || s END AS sec FROM l GROUP BY ALL)
SELECT l_orderkey, q, min(ord) AS ord FROM g GROUP BY l_orderkey, q, sec""")
def q_consolidated_specs(spark, sf_dir):
    q = F.col("l_quantity").cast("long") % 2
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", q.alias("q"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, "Read (0Bh / 0Ch)").otherwise("READ (0ch/0bh) ").alias("parameter"),
                                                   F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("section"), F.when(q == 1, "Command").otherwise("AC").alias("spec_type"), F.lit("c").alias("condition"), F.col("l_linenumber").alias("page"))
    return consolidate.consolidate_specs(rows, ["l_orderkey"], ["spec_type", "parameter"], ["q"], "ord").select("l_orderkey", "q", "ord")


@query("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey % 6 AS code FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0), k AS (SELECT o_custkey AS doc, o_orderkey % 6 AS code FROM orders GROUP BY ALL),
s AS (SELECT o_custkey AS doc, l_orderkey * 10 + l_linenumber AS cfg, min(l_partkey) % 12 AS code, min(l_partkey) AS max FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY ALL),
r AS (SELECT c.doc, id, '0' || c.code || 'h' AS opcode, 'parameter-table' AS origin, 'P0 = ' || cfg AS setting, max FROM c JOIN s ON c.doc = s.doc AND c.code = s.code
  UNION ALL SELECT doc, id, '0' || code || 'h', 'read-group', NULL, NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = c.doc AND s.code = c.code)
  UNION ALL SELECT doc, NULL, '0' || to_base(code, 16) || 'h', 'parameter-table', 'P0 = ' || cfg, max FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc = s.doc AND k.code = s.code))
SELECT doc, id AS command_id, p.product, replace(replace(opcode, '0ah', '0Ah'), '0bh', '0Bh') AS opcode, origin, setting, coalesce(max, CASE WHEN opcode = '03h' THEN 50 ELSE 133 END)::BIGINT AS max, CASE WHEN opcode = '03h' THEN 'read-data' ELSE 'except' END AS kind,
  CASE WHEN id IS NULL THEN '設定表列出 ' || replace(replace(opcode, '0ah', '0Ah'), '0bh', '0Bh') || '，指令總表未找到對應定義，Address 等欄位未推定。' END AS reason FROM r, (SELECT unnest(['P1', 'P2']) AS product) p""")
def q_supplemented_reads(spark, sf_dir):
    n = F.col("o_orderkey")
    hexed = lambda c: F.concat(F.lit("0"), F.lower(F.hex(c)), F.lit("h"))
    orders = table(spark, sf_dir, "orders")
    found = orders.select(F.col("o_custkey").alias("doc"), n.alias("command_id"), F.when(n % 5 == 0, "Set Read Parameters").otherwise("Fast Read").alias("command"), hexed(n % 6).alias("opcode"), F.lit("1-1-1").alias("mode"), F.lit("s").alias("section"), F.when(n % 7 == 0, "Max: 50 MHz").otherwise("x").alias("extra"))
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").join(orders.select(n.alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy(F.col("o_custkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("config_id")).agg(F.min("l_partkey").alias("max"))
    code = F.concat(F.lit("0"), F.hex(F.col("max") % 12), F.lit("h"))
    sets = lines.select("doc", "config_id", F.array(code).alias("codes"), F.lit("SPI").alias("mode"), F.concat(F.lit("P0 = "), F.col("config_id").cast("string")).alias("setting"), F.lit(8).alias("dummy"), F.col("max").cast("long").alias("max"))
    kinds = (("Clock frequency except Read Data and DTR", "except", 1, 133), ("Clock frequency, Read Data instruction (03h)", "read-data", 2, 50))
    made = [F.struct(F.lit(p).alias("product"), F.lit("fC").alias("symbol"), F.lit(text).alias("parameter"), F.lit(kind).alias("kind"), F.lit(o).alias("ord"), F.lit(m).cast("long").alias("max")) for p in ("P1", "P2") for text, kind, o, m in kinds]
    docs = orders.select(F.col("o_custkey").alias("doc")).distinct()
    groups = docs.select("doc", F.explode(F.array(*made)).alias("g")).select("doc", "g.*")
    got = specs.supplemented_reads(found, sets, groups, docs.withColumns({"page": F.lit(1), "text": F.lit("")}), ["doc"])
    return got.select("doc", "command_id", "product", "opcode", "origin", "setting", "max", "kind", "reason")


def public_rows(df, doc, **given):
    """Specification rows with the given columns, the others blank."""
    kinds = {"ord": "bigint", "page": "int", "command_id": "bigint"}
    names = ("ord", "product", "spec_type", "parameter", "symbol", "max", "typ", "min", "unit", "condition", "description", "page", "section", "start", "opcode", "mode", "io", "setting", "dummy", "commands", "command_id")
    blank = lambda c: F.lit("") if c in ("max", "typ", "min", "unit", "symbol", "condition", "description") else F.lit(None)
    return df.select(doc, *[given.get(c, blank(c)).cast(kinds.get(c, "string")).alias(c) for c in names])


def group_rows(docs, doc, groups):
    made = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("ord", "product", "parameter", "max", "condition"), g)]) for g in groups]
    each = docs.select(doc, F.explode(F.array(*made)).alias("g")).select(doc, "g.*")
    return public_rows(each, doc, spec_type=F.lit("AC"), unit=F.lit("MHz"), page=F.lit(90), symbol=F.lit("FR"), **{c: F.col(c) for c in ("ord", "product", "parameter", "max", "condition")})


def of_products(commands, doc, products, mode):
    each = commands.select("*", F.posexplode(F.array(*map(F.lit, products))).alias("k", "product"))
    condition = F.concat(F.lit("opcode="), "opcode", F.lit("; IO="), "mode")
    return public_rows(each, doc, ord=10 + len(products) * F.col("command_id") + F.col("k"), product=F.col("product"), spec_type=F.lit("Command"), parameter=F.col("command"), condition=condition, page=F.lit(5), opcode=F.col("opcode"), mode=mode, io=F.col("mode"), command_id=F.col("command_id"))


#: A customer's orders are instructions, some of them settings too; one product has both read groups, the other one of them.
@query("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey % 6 AS code, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS free FROM orders),
g AS (SELECT * FROM (VALUES ('P1', 'except', 133, 1), ('P1', 'read-data', 50, 2), ('P2', 'read-data', 50, 3)) t(product, kind, max, ord)), s AS (SELECT doc, id AS cfg, id % 12 AS code, id % 90 AS max FROM c WHERE id % 4 = 1),
r AS (SELECT c.*, product, 10 + 2 * id + k AS ord, CASE WHEN code = 3 THEN 'read-data' ELSE 'except' END AS kind FROM c, (VALUES ('P1', 0), ('P2', 1)) p(product, k)),
x AS (SELECT r.*, '0' || r.code || 'h' AS opcode, 'opcode=0' || r.code || 'h; IO=1-1-1' AS condition, free AND g.kind IS NOT NULL AS fits, g.max AS limit_, EXISTS (SELECT 1 FROM s WHERE s.doc = r.doc AND s.code = r.code) AS told, doc % 5 = 0 AND r.code = 2 AS unread FROM r LEFT JOIN g ON g.product = r.product AND g.kind = r.kind)
SELECT x.doc, ord, product, 'AC' AS spec_type, opcode, s.max || '.0' AS max, 'parameter-table' AS origin, kind AS read_group, 'P0 = ' || cfg AS setting, condition || '; P0 = ' || cfg || '; Dummy=8' AS condition, NULL AS status FROM x JOIN s ON x.doc = s.doc AND x.code = s.code WHERE fits
UNION ALL SELECT doc, ord, product, 'AC', opcode, limit_::VARCHAR, 'read-group', kind, NULL, condition, NULL FROM x WHERE fits AND NOT told AND NOT unread
UNION ALL SELECT doc, ord, product, 'Command', opcode, '', NULL, NULL, NULL, condition, NULL FROM x WHERE NOT fits OR (NOT told AND unread)
UNION ALL SELECT doc, ord, product, 'AC', NULL, max::VARCHAR, NULL, kind, NULL, '', NULL FROM (SELECT DISTINCT doc FROM c), g
UNION ALL SELECT doc, 1152921504606846976, product, 'AC', o, s.max || '.0', 'parameter-table', kind, 'P0 = ' || cfg, 'opcode=' || o || '; SPI; P0 = ' || cfg || '; Dummy=8', 'review'
  FROM (SELECT *, '0' || upper(to_base(code, 16)) || 'h' AS o FROM s) s JOIN g ON g.kind = CASE WHEN code = 3 THEN 'read-data' ELSE 'except' END WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = s.doc AND c.code = s.code)""")
def q_read_rows(spark, sf_dir):
    n = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    code = lambda k: F.concat(F.lit("0"), F.hex(k), F.lit("h"))
    commands = orders.select(F.col("o_custkey").alias("doc"), n.alias("command_id"), F.when(n % 5 == 0, "Set Read Parameters").otherwise("Fast Read").alias("command"), code(n % 6).alias("opcode"), F.lit("1-1-1").alias("mode"), F.lit("s").alias("section"), F.when(n % 7 == 0, "Any Address (MHz): X").otherwise("").alias("extra"))
    docs = commands.select("doc").distinct()
    groups = group_rows(docs, "doc", [(1, "P1", "Clock frequency except for Read Data (03h) & DTR instructions", "133", ""), (2, "P1", "Clock frequency for Read Data instruction (03h)", "50", ""), (3, "P2", "Clock frequency for Read Data instruction (03h)", "50", "")])
    none = F.lit(None).cast("string")
    sets = orders.filter(n % 4 == 1).select(F.col("o_custkey").alias("doc"), n.alias("config_id"), F.array(code(n % 12)).alias("codes"), F.lit("SPI").alias("mode"), F.concat(F.lit("P0 = "), n.cast("string")).alias("setting"), F.lit(8).alias("dummy"), (n % 90).cast("double").alias("max"), F.lit("").alias("start"), F.lit("").alias("note"), F.lit("raw").alias("raw"), F.lit(73).alias("page"), F.lit("s").alias("section"), none.alias("conflict"))
    scopes = docs.filter("doc % 5 = 0").select("doc", F.array(F.lit("02h")).alias("codes"), F.lit("SPI").alias("mode"), F.lit(True).alias("unresolved"))
    pages = docs.select("doc", F.lit(1).alias("page"), F.lit(1).alias("printed"), F.lit("").alias("text"))
    rows = groups.unionByName(of_products(commands, "doc", ("P1", "P2"), F.lit("SPI")))
    return reads.read_rows(rows, commands, sets, scopes, pages, ["doc"]).select("doc", "ord", "product", "spec_type", "opcode", "max", "origin", "read_group", "setting", "condition", "status")


@query("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey % 5 AS code, o_orderkey % 4 AS m, o_orderkey % 3 > 0 AS reads FROM orders),
v AS (SELECT id, '1-1-8（SDR）' AS io, 'SDR' AS rate FROM c WHERE m < 2 UNION ALL SELECT id, '8d-8d-8d', 'DDR' FROM c WHERE m > 0 UNION ALL SELECT id, '2-2-2', NULL FROM c WHERE m = 3),
d AS (SELECT doc FROM c GROUP BY doc HAVING max(m) > 0), r AS (SELECT c.*, product, 10 + 3 * id + k AS ord, 'opcode=0' || code || 'h; IO=' AS cond, concat_ws('；', CASE WHEN m < 2 THEN '1-1-8（SDR）' END, CASE WHEN m > 0 THEN '8d-8d-8d' END, CASE WHEN m = 3 THEN '2-2-2' END) AS modes, doc IN (FROM d) AS octal FROM c, (VALUES ('P1', 0), ('P2', 1), ('P3', 2)) p(product, k)),
x AS (SELECT r.*, io, rate, reads AND rate = CASE product WHEN 'P1' THEN 'SDR' ELSE 'DDR' END AS hit FROM r JOIN v ON r.id = v.id WHERE octal AND product <> 'P3')
SELECT doc, ord, product, CASE WHEN hit THEN 'AC' ELSE 'Command' END AS spec_type, coalesce(rate, io) AS mode, io, CASE WHEN hit THEN CASE WHEN product = 'P2' THEN '200' WHEN code = 3 THEN '54' ELSE '166' END ELSE '' END AS max, CASE WHEN hit THEN 'octal-read-group' END AS origin,
  cond || io || CASE WHEN hit THEN CASE WHEN product = 'P2' THEN '; ODDR; T' ELSE '; SDR' END ELSE '' END AS condition FROM x
UNION ALL SELECT doc, ord, product, 'Command', 'SPI', modes, '', NULL, cond || modes FROM r WHERE NOT octal OR product = 'P3'
UNION ALL SELECT doc, ord, product, 'AC', CASE WHEN doc IN (FROM d) THEN rate END, NULL, max, NULL, condition FROM (SELECT DISTINCT doc FROM c), (VALUES (1, 'P1', '54', 'SDR', 'SDR'), (2, 'P1', '166', 'SDR', 'SDR'), (3, 'P2', '200', 'ODDR; T', 'DDR')) g(ord, product, max, condition, rate)""")
def q_octal_rows(spark, sf_dir):
    n = F.col("o_orderkey")
    mode = F.concat_ws("；", F.when(n % 4 < 2, "1-1-8（SDR）"), F.when(n % 4 > 0, "8d-8d-8d"), F.when(n % 4 == 3, "2-2-2"))
    commands = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), n.alias("command_id"), F.when(n % 3 > 0, "Read Array").otherwise("Write Enable").alias("command"), F.concat(F.lit("0"), (n % 5).cast("string"), F.lit("h")).alias("opcode"), mode.alias("mode"), F.lit("s").alias("section"), F.lit("").alias("extra"))
    docs = commands.select("doc").distinct()
    groups = group_rows(docs, "doc", [(1, "P1", "Clock frequency for Read (03h/0Bh)", "54", "SDR"), (2, "P1", "Clock frequency except for Read", "166", "SDR"), (3, "P2", "Clock frequency except for Read", "200", "ODDR; T")])
    rows = groups.unionByName(of_products(commands, "doc", ("P1", "P2", "P3"), F.lit("SPI")))
    return reads.octal_reads(rows, commands, ["doc"]).select("doc", "ord", "product", "spec_type", "mode", "io", "max", "origin", "condition")
