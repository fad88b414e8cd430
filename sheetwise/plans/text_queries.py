"""Queries of the scalar text functions over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import text as t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The blanks of `functions.text.BLANK`, as DuckDB's expressions write them.
SQL_BLANK = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_clean(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '{SQL_BLANK}+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned, length({sql_clean('text')})::BIGINT AS n FROM documents")
def q_clean_text(spark, sf_dir):
    c = t.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(c, "UTF-8")).alias("cleaned"), F.length(c).cast("long").alias("n"))


@query(f"""SELECT p_partkey, {sql_clean(r"regexp_replace(p_name || ' (' || p_size || ', 2) ' || p_brand || '(3)', '\(\s*\d+(?:\s*[,，]\s*\d+)*\s*\)', '', 'g')")} AS bare,
  {sql_clean(r"regexp_replace(regexp_replace('8 (Def.) (' || p_size || ')', '(?i)\(\s*Def\.?\s*\)', '', 'g'), '\(\s*\d+(?:\s*[,，]\s*\d+)*\s*\)', '', 'g')")} AS dummy FROM part""")
def q_strip_notes(spark, sf_dir):
    noted = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_size").cast("string"), F.lit(", 2) "), F.col("p_brand"), F.lit("(3)"))
    dummy = F.concat(F.lit("8 (Def.) ("), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", t.strip_notes(noted).alias("bare"), t.strip_dummy_notes(dummy).alias("dummy"))


CODE_TEXT = "printf('Read %02xh(1) / %02XH, %02xh of %s', p_partkey % 5 + 10, p_size % 5 + 10, p_partkey % 3 + 10, p_type)"
ORDERED_CODES = """WITH c AS (SELECT p_partkey, p_type, [upper(printf('%02x', p_partkey % 5 + 10)) || 'h', upper(printf('%02x', p_size % 5 + 10)) || 'h', upper(printf('%02x', p_partkey % 3 + 10)) || 'h'] AS l FROM part),
u AS (SELECT p_partkey, p_type, CASE WHEN l[2] = l[1] THEN CASE WHEN l[3] = l[1] THEN [l[1]] ELSE [l[1], l[3]] END
  WHEN l[3] IN (l[1], l[2]) THEN [l[1], l[2]] ELSE l END AS d FROM c)"""


def code_text():
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    return F.concat(F.lit("Read "), hexed(F.col("p_partkey") % 5 + 10), F.lit("h(1) / "), F.upper(hexed(F.col("p_size") % 5 + 10)), F.lit("H, "), hexed(F.col("p_partkey") % 3 + 10), F.lit("h of "), F.col("p_type"))


@query(ORDERED_CODES + " SELECT p_partkey, 'Read ' || array_to_string(d, '/') || ' of ' || p_type AS opcode FROM u")
def q_opcode_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.normalize_opcode(code_text()).alias("opcode"))


@query(ORDERED_CODES + " SELECT p_partkey, lower('Read ' || array_to_string(list_sort(d), '/') || ' of ' || p_type) AS identity FROM u")
def q_identity_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.identity_text(code_text()).alias("identity"))


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1,234.5' WHEN 1 THEN '– ' || o_custkey WHEN 2 THEN '±2' WHEN 3 THEN 'D.C.' WHEN 4 THEN '1e3' ELSE (o_custkey + 1) || ',000' END AS s, o_custkey FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1234.5 WHEN 1 THEN -o_custkey::DOUBLE WHEN 5 THEN replace(s, ',', '')::DOUBLE END AS number,
  CASE o_orderkey % 6 WHEN 0 THEN '1234.5' WHEN 1 THEN CASE WHEN o_custkey = 0 THEN '0' ELSE '-' || o_custkey END WHEN 5 THEN replace(s, ',', '') ELSE s END AS shown FROM v""")
def q_numeric_value(spark, sf_dir):
    key, cust = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    s = F.when(key == 0, "1,234.5").when(key == 1, F.concat(F.lit("– "), cust)).when(key == 2, "±2").when(key == 3, "D.C.").when(key == 4, "1e3").otherwise(F.concat((F.col("o_custkey") + 1).cast("string"), F.lit(",000")))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.numeric_value(s).alias("number"), t.limit_text(s).alias("shown"))


@query("""SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(upper(text || ' AB12Q' || item_id || 'RW-DTR and XY9, Z1'), '\\b([A-Z]+\\d[A-Z0-9]*(?:-[A-Z][A-Z0-9]*)?)\\b', 1),
  lambda p: regexp_replace(p, '-DTR$', '')), lambda p: length(p) >= 6 AND length(regexp_replace(p, '\\D', '', 'g')) >= 2 AND regexp_matches(p, '^[^0-9]*\\d.*[A-Z]')))) AS models FROM benchmark""")
def q_model_tokens(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" AB12Q"), F.col("item_id").cast("string"), F.lit("RW-DTR and XY9, Z1"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.sort_array(t.product_tokens(text)).alias("models"))


@query("""SELECT c_custkey, unnest([(c_nationkey + 1), 7, (c_custkey % 4 + 1)])::BIGINT AS page FROM customer WHERE c_nationkey + 1 <> 7 AND c_custkey % 4 + 1 NOT IN (7, c_nationkey + 1)
UNION ALL SELECT c_custkey, unnest(list_distinct([(c_nationkey + 1), 7, (c_custkey % 4 + 1)]))::BIGINT FROM customer WHERE NOT (c_nationkey + 1 <> 7 AND c_custkey % 4 + 1 NOT IN (7, c_nationkey + 1))""")
def q_page_list_parse(spark, sf_dir):
    listed = F.concat_ws(", ", (F.col("c_nationkey") + 1).cast("string"), F.lit("07"), (F.col("c_custkey") % 4 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(t.page_list(listed)).alias("page")).withColumn("page", F.col("page").cast("long"))


@query("""SELECT o_orderkey, o_orderpriority || '; ' || o_orderstatus AS without, o_orderpriority || '; Starting Address: Any; ' || o_orderstatus AS changed, lower(o_orderpriority) || ';' || lower(o_orderstatus) AS remainder FROM orders""")
def q_condition_fields(spark, sf_dir):
    c = F.concat(F.col("o_orderpriority"), F.lit(" ;  Starting  Address = Aligned；"), F.col("o_orderstatus"))
    more = F.concat(F.lit("SPI_DTR; opcode=0Bh；3-byte address; "), c, F.lit("; IO=1-1-1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.without_starting(c).alias("without"), t.with_starting(c, F.lit("Any")).alias("changed"), t.frequency_remainder(more).alias("remainder"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'SPI' WHEN 'click' THEN 'QPI_DTR' WHEN 'error' THEN 'SPI（SDR）；QPI_DTR（ODDR）' WHEN 'purchase' THEN 'SPI_DTR' ELSE 'SPI_DTR；other' END AS mode,
  CASE WHEN event_type = 'view' THEN 'none' WHEN event_type = 'click' THEN '3/4' WHEN event_type = 'error' THEN '4' WHEN event_type = 'purchase' THEN '3' ELSE 'A15-A8' END AS address FROM events""")
def q_mode_split(spark, sf_dir):
    kind = F.col("event_type")
    mode = F.when(kind == "view", "spi").when(kind == "click", "QPI-DDR").when(kind == "error", "1-1-1（SDR）；4d-4d-4d（ODDR）").when(kind == "purchase", "1-1d-1d").otherwise("SPI DTR; other")
    address = F.when(kind == "view", "--").when(kind == "click", "3-/4-byte Address").when(kind == "error", "A31-A0").when(kind == "purchase", "A23–A16, A15-A8, A7-A0 (2)").otherwise("A15-A8")
    return table(spark, sf_dir, "events").select("event_id", t.interface_mode(mode).alias("mode"), t.address_key(address).alias("address"))


@query("""SELECT md5(regexp_replace(text, '[ \\n\\t\\r]+', '', 'g')) AS k, count(*)::BIGINT AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1""")
def q_compact_key_dups(spark, sf_dir):
    key = F.md5(F.encode(F.regexp_replace("text", t.BLANK + "+", ""), "UTF-8"))
    return table(spark, sf_dir, "documents").groupBy(key.alias("k")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


@query("""SELECT page_id, h1 || ' ⟨PART⟩ and ⟨PART⟩' AS masked, regexp_replace(lower(h1 || ' ⟨PART⟩'), '[^a-z0-9⟨⟩]+', '', 'g') AS title FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages)""")
def q_mask_parts(spark, sf_dir):
    h1 = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    number = F.concat(F.lit("W25Q"), (F.col("page_id") % 90 + 10).cast("string"), F.lit("MV"))
    return table(spark, sf_dir, "pages").select("page_id", t.mask_parts(F.concat_ws(" ", h1, number, F.lit("and W25Q32/64/12RW-DTR"))).alias("masked"), t.title_key(F.concat_ws(" ", h1, number)).alias("title"))


#: The prefix in compatibility form is written out; the texts have no characters that have another one.
SQL_FOLDED = r'''regexp_replace(regexp_replace(regexp_replace(text, '[‘’‚′`´]', chr(39), 'g'), '[“”„″]', '"', 'g'), '[‐-―−]', '-', 'g')'''


@query(f'''SELECT doc_id, md5({sql_clean("'fi2 ' || repeat(chr(39), 2) || 'A' || repeat(chr(39), 2) || ' ' || " + SQL_FOLDED)}) AS normal FROM documents''')
def q_nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(t.normalize_text(F.concat(F.lit("ﬁ² ″Ａ″ "), F.col("text"))), "UTF-8")).alias("normal"))


@query("""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9⟨⟩]+')) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(2.0 * length(list_intersect(a.s, b.s)) / (length(a.s) + length(b.s)), 9) AS similarity FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def q_dice_pairs(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", t.word_set(F.col("text")).alias("s"))
    return w.alias("a").join(w.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(t.dice(F.col("a.s"), F.col("b.s")), 9).alias("similarity"))


#: Abbreviations are guarded, then texts are cut; replacements are made twice, as DuckDB's matches can't share a character.
SQL_GUARD = "'(?i)((?:^|[^A-Za-z0-9_])(?:" + "|".join(a.replace(".", r"\.") for a in t.ABBREVIATIONS) + r"))\.(\s|(?-i:[A-Z]))', '\1' || chr(1) || '\2', 'g'"
SQL_GLUED = r"""'([a-z''’"”)])([.!?;。！？])([A-Z][a-z\s])', '\1\2' || chr(30) || '\3', 'g'"""
SQL_GUARDED = f"regexp_replace(regexp_replace({sql_clean('text')}, {SQL_GUARD}), {SQL_GUARD})"
SQL_CUT = f"""regexp_replace({SQL_GUARDED}, '([.!?;。！？])\\s+([A-Z(“"''‘])', '\\1' || chr(30) || '\\2', 'g')"""
SQL_SENTENCES = f"list_transform(string_split(replace(regexp_replace(regexp_replace({SQL_CUT}, {SQL_GLUED}), {SQL_GLUED}), chr(1), '.'), chr(30)), lambda s: trim(s))"


@query(f"SELECT doc_id, ord - 1 AS ord, sentence FROM (SELECT doc_id, unnest(list_filter({SQL_SENTENCES}, lambda s: s <> '')) AS sentence, generate_subscripts(list_filter({SQL_SENTENCES}, lambda s: s <> ''), 1)::BIGINT AS ord FROM documents)")
def q_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(t.split_sentences(F.col("text"))).alias("ord", "sentence")).select("doc_id", F.col("ord").cast("long").alias("ord"), "sentence")


@query("""SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '…（已截斷）' ELSE text END AS cell FROM documents""")
def q_cell_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.cut_cell(F.col("text"), 1000).alias("cell"))
