r"""Operator 7: chat formatting by prefix-target expansion (built-in functions only).

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is
trainable. Turns after the last assistant turn form one closing example that trains nothing, so that every turn
can be read back. A turn is rendered as ``<turn role>text</turn>``. Inside texts and roles ``&`` becomes ``&amp;``,
``<`` becomes ``&lt;`` and ``>`` becomes ``&gt;``, so no text can open, close or fake a turn; reading back
undoes the three in reverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Template marks.
OPEN, OPENED, CLOSE = "<turn ", ">", "</turn>"
#: The conversation that the contract adds: a text that looks like control strings.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Examples of all conversations: conv_id, example (0, 1, ...), formatted, loss_start, loss_length.

    The loss mask covers `loss_length` code points of `formatted` from `loss_start` (0-based); the closing example
    of trailing turns has length -1. Turns are ordered by turn, then role and text, so ties and repeated rows have
    one order and are all kept. Null texts and roles are empty; null turns come first; rows of a null conv_id form
    one conversation. Only the four named columns are read, so further ones can't clash. An empty table gives none.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rendered = chats.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(OPENED))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    last = F.size("roles")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: (F.get("roles", i - 1) == "assistant") | (i == last))
    examples = rendered.select("*", F.posexplode(targets).alias("example", "target"))
    whole = F.transform(F.arrays_zip(F.col("heads"), F.col("bodies")), lambda x: F.concat(x["heads"], x["bodies"], F.lit(CLOSE)))
    context = F.array_join(F.slice(whole, F.lit(1), F.col("target") - 1), "")
    head, body = F.get("heads", F.col("target") - 1), F.get("bodies", F.col("target") - 1)
    trained = F.get("roles", F.col("target") - 1) == "assistant"
    opening = examples.select("conv_id", "example", F.concat(context, head).alias("opening"), body.alias("body"), trained.alias("trained"))
    return opening.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat("opening", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("opening").alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).otherwise(-1).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trained replies of each conversation, from the formatted strings and the loss mask alone."""
    reply = F.when(F.col("loss_length") >= 0, unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length"))))
    merged = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(reply.isNotNull(), F.struct("example", reply.alias("reply"))))).alias("replies"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    pieces = F.filter(F.split("longest", CLOSE), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, OPENED, 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, OPENED, 1)) + 2)).alias("text"),
    ))
    return merged.select("conv_id", turns.alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"), "formatted_chars")


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    chats = read_back(format_chats(table.unionByName(probe)))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: formatted_chars: each assistant turn repeats all turns before it; a conversation that ends otherwise has one more example.
ORACLE_OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(14 + length(role) + length(text)
      + 4 * (length(role || text) - length(replace(role || text, '&', '')))
      + 3 * (length(role || text) - length(replace(replace(role || text, '<', ''), '>', '')))) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
