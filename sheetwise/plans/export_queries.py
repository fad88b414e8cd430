"""Queries of the sheets, filters and unions over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import exports
from sheetwise.plans.text_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STATUS = "['changed', 'added', 'removed', 'review', 'unchanged']"
LABEL = "['變更', '新增', '移除', '待確認', '未變更']"


@query(f"""WITH o AS (SELECT *, {STATUS}[o_orderkey % 5 + 1] AS status FROM orders)
SELECT {LABEL}[o_orderkey % 5 + 1] AS "比較結果",
  CASE status WHEN 'changed' THEN 'Address：空白 → ' || o_custkey || '；note：a → b' WHEN 'added' THEN '新版新增，舊版無對應指令。' WHEN 'removed' THEN '舊版有此指令，新版已移除；本列內容為舊版。'
    WHEN 'review' THEN '相同 介面模式／指令名稱／Opcode／設定 出現多筆，未自動配對，請人工核對。' ELSE '' END AS "變更說明（舊 → 新）",
  o_orderstatus AS "介面模式", 'Read ' || o_orderkey AS "指令名稱", '6Bh/0Ch' AS "Opcode", '' AS "設定", o_custkey::VARCHAR AS "Address", '8' AS "Dummy", o_orderpriority AS "Data", 'x' AS "其他欄位", 'g' AS "分組", 's' AS "章節",
  CASE WHEN status = 'removed' THEN '' ELSE o_custkey::VARCHAR END AS "新版頁碼", CASE status WHEN 'removed' THEN o_custkey::VARCHAR WHEN 'changed' THEN '7' END AS "舊版頁碼" FROM o""")
def q_command_sheet(spark, sf_dir):
    n = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("changed", "added", "removed", "review", "unchanged"))), (n % 5 + 1).cast("int"))
    change = lambda f, o, v: F.struct(F.lit(f).alias("field"), o.alias("old"), v.alias("new"))
    rows = table(spark, sf_dir, "orders").select(
        status.alias("status"), F.array(change("address", F.lit(""), F.col("o_custkey").cast("string")), change("note", F.lit("a"), F.lit("b"))).alias("changes"),
        F.col("o_orderstatus").alias("mode"), F.concat(F.lit("Read "), n.cast("string")).alias("command"), F.lit("6bh(1), 0CH").alias("opcode"), F.lit("").alias("setting"), F.col("o_custkey").cast("string").alias("address"),
        F.lit("8 (Def.) (2)").alias("dummy"), F.col("o_orderpriority").alias("data"), F.lit("x").alias("extra"), F.lit("g").alias("group"), F.lit("s").alias("section"), F.col("o_custkey").alias("page"), F.when(status == "changed", "7").alias("old_page"))
    return exports.command_rows(rows)


@query(f"""WITH p AS (SELECT *, {STATUS}[p_partkey % 5 + 1] AS status FROM part)
SELECT {LABEL}[p_partkey % 5 + 1] AS "比較結果", CASE status WHEN 'changed' THEN 'max, unit' ELSE '' END AS "變更欄位",
  CASE status WHEN 'changed' THEN 'max：1 → ' || p_size || '；unit：空白 → V' WHEN 'added' THEN '新版新增，舊版無對應規格。' WHEN 'removed' THEN '舊版有此規格，新版已移除；本列數值為舊版內容。'
    WHEN 'review' THEN CASE WHEN p_partkey % 2 = 0 THEN 'odd ' || p_partkey ELSE '相同產品／規格類型／symbol／parameter／condition 出現多筆，未自動配對，請人工核對。' || chr(10)
      || '舊版候選 1：max ' || p_size || '、typ 空白、min 1、unit V（舊版頁 4）' || chr(10) || '舊版候選 2：max 空白、typ 2、min 空白、unit V（舊版頁 空白）' END ELSE '' END AS "變更說明（舊 → 新）",
  p_brand AS "產品名稱", CASE WHEN p_partkey % 3 = 0 THEN '9Fh' ELSE '02h/20h/21h' END AS "Opcode", 'V' AS unit, p_size::VARCHAR AS max, '' AS typ, '1' AS min, 'ICC' AS symbol,
  CASE p_partkey % 4 WHEN 0 THEN 'QPI_DTR' WHEN 1 THEN 'SPI' WHEN 2 THEN 'Both' END AS "SPI/QPI", '3' AS "3/4 byte address", CASE WHEN p_partkey % 2 = 0 THEN '8' ELSE 'n' END AS "Dummy", 'Any' AS "Starting Address", 'AC' AS "spec type",
  CASE p_partkey % 4 WHEN 2 THEN 'Page Program（1-1-1, 4-4-4）；Erase' ELSE 'Page Program；Erase' END AS "相關指令", p_name AS parameter, 'c' AS condition, 'd' AS description,
  CASE WHEN status = 'removed' THEN '' ELSE p_size::VARCHAR END AS "新版頁碼", CASE status WHEN 'removed' THEN p_size::VARCHAR WHEN 'review' THEN '4' WHEN 'changed' THEN '9' END AS "舊版頁碼" FROM p""")
def q_comparison_sheet(spark, sf_dir):
    n = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ("changed", "added", "removed", "review", "unchanged"))), (n % 5 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    change = lambda f, o, v: F.struct(F.lit(f).alias("field"), F.lit(o).alias("old"), v.alias("new"))
    offer = lambda *v: F.struct(*[(x if not isinstance(x, str) else F.lit(x)).alias(k) for k, x in zip(("max", "typ", "min", "unit", "page"), v)])
    names = F.when(n % 4 == 2, "02h Page Program（1-1-1, 4-4-4）；20H (2)/21h(3) Erase").otherwise("02h Page Program; 20h/21h(3) Erase")
    rows = table(spark, sf_dir, "part").select(
        status.alias("status"), F.array(change("max", "1", size), change("unit", "", F.lit("V"))).alias("changes"), F.when((status == "review") & (n % 2 == 0), F.concat(F.lit("odd "), n.cast("string"))).alias("conflict"),
        F.array(offer(size, "", "1", "V", "4"), offer("", "2", "", "V", "")).alias("candidates"), F.col("p_brand").alias("product"), F.when(n % 3 == 0, "9FH").alias("opcode"), F.lit("V").alias("unit"), size.alias("max"), F.lit("").alias("typ"),
        F.lit("1").alias("min"), F.lit("ICC").alias("symbol"), F.when(n % 4 == 0, "4-4-4").when(n % 4 == 1, "SPI").alias("mode"), F.lit("DTR rates").alias("section"), F.lit("3").alias("address"),
        F.when(n % 2 == 0, "8 (Def)").otherwise("n (3)").alias("dummy"), F.lit("Any").alias("start"), F.lit("AC").alias("spec_type"), names.alias("commands"), F.col("p_name").alias("parameter"), F.lit("c").alias("condition"), F.lit("d").alias("description"),
        F.col("p_size").alias("page"), F.when(status == "changed", "9").alias("old_page"))
    return exports.comparison_rows(rows)


def chunks(t, v):
    return F.struct(t.alias("t"), v.alias("v"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN '' ELSE 'plain' END || CASE WHEN length(text) < 32000 THEN '|gone' ELSE '' END || CASE WHEN 2 * length(text) < 32000 THEN '|come' ELSE '' END || CASE WHEN 2 * length(text) + 3 >= 32000 THEN '|plain' ELSE '|part_old|part_new' END AS styles,
  least(32000, 2 * length(text) + CASE WHEN 2 * length(text) + 3 >= 32000 THEN 3 ELSE 7 END) + CASE WHEN 2 * length(text) + 3 >= 32000 THEN 6 ELSE 0 END AS n
FROM documents WHERE length(text) > 0 AND 2 * length(text) + 3 NOT BETWEEN 31980 AND 32005""")
def q_cell_runs(spark, sf_dir):
    text = F.col("text")
    part = F.struct(F.lit("part").alias("t"), F.lit(None).cast("string").alias("v"), F.lit("W2").alias("o"), F.lit("W3").alias("n"))
    made = F.array(chunks(F.lit("eq"), text), chunks(F.lit("del"), text), chunks(F.lit("ins"), F.lit("new")), part)
    rows = table(spark, sf_dir, "documents").filter((F.length("text") > 0) & ~(2 * F.length("text") + 3).between(31980, 32005)).select("doc_id", exports.runs(made).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform("r", lambda x: x["style"]), "|").alias("styles"), F.aggregate("r", F.lit(0), lambda a, x: a + F.length(x["text"])).cast("long").alias("n"))


LINES = "o.o_custkey, l_orderkey, l_linenumber, ['same', 'part', 'changed', 'added', 'removed'][(l_partkey % 5 + 1)::INT] AS status, l_returnflag || CASE WHEN l_partkey % 11 = 0 THEN ' Shipped' ELSE '' END AS old_text, l_linestatus AS new_text"


def pieces(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*map(F.lit, ("same", "part", "changed", "added", "removed"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("o_custkey", F.col("l_orderkey").alias("section"), F.col("l_linenumber").cast("long").alias("position"), status.alias("status"), F.concat("l_returnflag", F.when(F.col("l_partkey") % 11 == 0, " Shipped").otherwise("")).alias("old_text"), F.col("l_linestatus").alias("new_text"))


@query(f"""WITH l AS (SELECT {LINES} FROM lineitem JOIN orders o ON l_orderkey = o_orderkey), h AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders)
SELECT h.o_custkey, o_orderkey AS section, -1::BIGINT AS position, CASE WHEN o_orderkey % 4 = 0 THEN '修改' ELSE '僅型號替換' END AS result, '2.1 ' || o_orderstatus AS new_section, '2 ' || o_orderpriority AS old_section,
  CASE WHEN o_orderkey % 4 = 0 THEN '〔章節標題〕/x' ELSE '〔章節標題〕/A/B' END AS marked, o_orderpriority AS old_text, o_orderstatus AS new_text FROM h WHERE o_orderkey % 2 = 0
UNION ALL SELECT l.o_custkey, l_orderkey, l_linenumber, ['相同', '僅型號替換', '修改', '新增', '移除'][list_position(['same', 'part', 'changed', 'added', 'removed'], status)], '2.1 ' || o_orderstatus, '2 ' || o_orderpriority,
  CASE WHEN status <> 'same' THEN old_text END, old_text, new_text FROM l JOIN h ON l_orderkey = o_orderkey""")
def q_narrative_sheet(spark, sf_dir):
    title = F.when(F.col("o_orderkey") % 4 == 0, F.array(chunks(F.lit("ins"), F.lit("x")))).when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("part").alias("t"), F.lit(None).cast("string").alias("v"), F.lit("A").alias("o"), F.lit("B").alias("n"))))
    titles = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("section"), F.col("o_orderpriority").alias("old_title"), F.col("o_orderstatus").alias("new_title"), F.lit("2").alias("old_number"), F.lit("2.1").alias("new_number"), title.alias("chunks"))
    body = pieces(spark, sf_dir).withColumn("chunks", F.array(chunks(F.lit("del"), F.col("old_text"))))
    rows = exports.narrative_rows(body, titles, ["o_custkey"])
    return rows.withColumn("marked", F.array_join(F.transform("runs", lambda r: r["text"]), "/")).drop("runs")


@query(f"""WITH l AS (SELECT {LINES} FROM lineitem JOIN orders o ON l_orderkey = o_orderkey), p AS (SELECT *, CASE WHEN status = 'part' THEN 'same' ELSE status END AS shown FROM l),
s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'same' ELSE 'changed' END AS shown, o_orderpriority AS label FROM orders)
SELECT p.o_custkey, l_orderkey AS section, l_linenumber AS position, p.shown AS status FROM p JOIN s ON l_orderkey = o_orderkey AND s.shown <> 'same' AND p.shown <> 'same'
  AND (lower(label) LIKE '%ship%' OR EXISTS (SELECT 1 FROM p q WHERE q.l_orderkey = p.l_orderkey AND lower(q.old_text || ' ' || q.new_text) LIKE '%ship%'))""")
def q_narrative_filter(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "part").otherwise("same")).otherwise("changed")
    sections = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("section"), status.alias("status"), F.col("o_orderpriority").alias("old_label"), F.lit("").alias("new_label"))
    _, kept = exports.narrative_filter(sections, pieces(spark, sf_dir), ["o_custkey", "section"], status="diff", search="Ship", hide_part=True, only_diff=True)
    return kept.select("o_custkey", "section", "position", "status")


@query("""WITH p AS (SELECT o_custkey, o_orderkey AS new_idx, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey + 1000000 END AS old_idx FROM orders),
c AS (SELECT o_custkey, o_orderkey AS pos, (SELECT max(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderkey <= o.o_orderkey - o.o_orderkey % 2) AS new_idx, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey + 1000000 END AS old_idx FROM orders o WHERE o_orderkey % 3 = 0),
l AS (SELECT o_custkey, new_idx, max(pos) AS pos, arg_max(coalesce(old_idx, -1), pos) AS old_idx FROM c WHERE new_idx IS NOT NULL GROUP BY ALL),
h AS (SELECT o_custkey, old_idx, arg_max(new_idx, pos) AS holder FROM l WHERE old_idx >= 0 GROUP BY ALL),
m AS (SELECT p.o_custkey, p.new_idx, CASE WHEN l.pos IS NULL THEN p.old_idx WHEN l.old_idx >= 0 THEN l.old_idx END AS old_idx FROM p LEFT JOIN l ON p.o_custkey = l.o_custkey AND p.new_idx = l.new_idx)
SELECT m.o_custkey, m.new_idx, CASE WHEN holder IS NULL OR holder = m.new_idx THEN m.old_idx END AS old_idx FROM m LEFT JOIN h ON m.o_custkey = h.o_custkey AND m.old_idx = h.old_idx""")
def q_manual_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    k, old = F.col("o_orderkey"), F.col("o_orderkey") + 1000000
    pairs = orders.select("o_custkey", k.alias("new_idx"), F.when(k % 5 > 0, old).alias("old_idx"))
    picked = orders.filter(k % 3 == 0).alias("c").join(orders.alias("i"), (F.col("c.o_custkey") == F.col("i.o_custkey")) & (F.col("i.o_orderkey") <= F.col("c.o_orderkey") - F.col("c.o_orderkey") % 2))
    choices = picked.groupBy("c.o_custkey", "c.o_orderkey").agg(F.max("i.o_orderkey").alias("new_idx")).select("o_custkey", k.alias("at"), "new_idx", F.when(k % 7 > 0, old).alias("old_idx"))
    return exports.repaired(pairs, choices, ["o_custkey"])


@query("""SELECT s_suppkey AS page, s_name AS section, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, '舊版 / ' || s_name, NULL FROM supplier WHERE s_suppkey % 3 = 0""")
def q_old_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_name").alias("section"), "s_nationkey")
    return exports.with_old(rows.filter("page % 2 = 0"), rows.filter("page % 3 = 0").drop("s_nationkey"), "section")


@query("""SELECT 'AC' AS kind, l_orderkey AS id, l_linestatus AS unit, NULL AS opcode FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'Command', o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0""")
def q_specs_and_commands(spark, sf_dir):
    specs = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.lit("AC").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("unit"))
    commands = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.lit("Command").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("opcode"))
    return exports.with_commands(specs, commands)


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, event_type, event_id % 4 = 0 AS notes FROM events),
u AS (SELECT user_id, page, min('used ' || event_type) AS label FROM p WHERE event_type = 'view' GROUP BY ALL), f AS (SELECT user_id, page + 1 AS page FROM u),
o AS (SELECT user_id, page, label FROM u UNION ALL SELECT user_id, page, 'Notes' FROM f WHERE EXISTS (SELECT 1 FROM p WHERE p.user_id = f.user_id AND p.page = f.page AND notes) AND NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = f.user_id AND u.page = f.page))
SELECT user_id, page, 'own' AS label, event_type AS text FROM p WHERE page % 5 = 0
UNION ALL SELECT p.user_id, p.page, o.label, event_type FROM o JOIN p ON o.user_id = p.user_id AND o.page = p.page WHERE p.page % 5 <> 0""")
def q_source_pages(spark, sf_dir):
    from pyspark.sql import Window

    pages = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("page"), F.col("event_type").alias("text"), (F.col("event_id") % 4 == 0).alias("notes_follow"))
    sources = pages.filter("page % 5 = 0").select("user_id", "page", F.lit("own").alias("label"), "text")
    used = pages.filter("text = 'view'").select("user_id", "page", F.concat(F.lit("used "), "text").alias("label"))
    return exports.source_pages(sources, used, pages, ["user_id"], "Notes")


@query("SELECT s_nationkey, array_to_string(list_sort(list_distinct(list(s_name))), ',') AS products FROM supplier WHERE s_name IS NOT NULL GROUP BY s_nationkey")
def q_product_list(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return exports.distinct_products(rows.union(rows), ["s_nationkey"], "s_name").select("s_nationkey", F.array_join("products", ",").alias("products"))


@query("SELECT r_name, 'region.parquet' AS filename, 'old.pdf' AS old_filename, true AS compared FROM region")
def q_file_names(spark, sf_dir):
    return exports.with_file(table(spark, sf_dir, "region"), "old.pdf").select("r_name", "filename", "old_filename", "compared")


@query("""SELECT n_regionkey, '# 新版' || chr(10) || chr(10) || string_agg('## ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 2 = 0) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '# 舊版' || chr(10) || chr(10) || coalesce(string_agg('## ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 2 = 1), '') AS markdown FROM nation GROUP BY n_regionkey""")
def q_comparison_markdown(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "new").otherwise("old").alias("side"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("## "), "n_name").alias("line"))
    return exports.comparison_markdown(lines, ["n_regionkey"])


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def q_filtered_export(spark, sf_dir):
    return exports.exported(table(spark, sf_dir, "part"), F.col("p_size") > 25).select("p_partkey")
