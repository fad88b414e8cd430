"""Operator 8: quality rules as learned decision lists (built-in functions only).

Sequential covering over per-document statistics: a rule is a conjunction of thresholds that describes low-quality
documents. It is grown condition by condition on two thirds of the labelled sample by information gain, pruned from
its end on the last third, and accepted while it stays precise; the rows it covers leave the sample and the next rule
is learned. The list becomes one ordered conditional expression over the statistics, which Spark compiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import SEPARATORS, stored, words

#: At most so many labelled rows are fitted, the first by a hash of their ids.
SAMPLE_ROWS = 20_000
#: Candidate thresholds of a statistic: its quantiles in the sample.
BINS = 32
#: A rule must be this precise on both parts of the sample and cover this many rows.
PRECISION, SUPPORT = 0.9, 5
MOST_RULES, MOST_CONDITIONS = 16, 4

@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text. Null texts have no words; repeated rows are counted each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    base = docs.select("doc_id", text.alias("_text"), words(F.col("text")).alias("_words"), lines.alias("_lines"))
    # Hashes stand for windows (two unequal ones of a text collide with a chance below 1e-9). Sorted by hash, equal
    # windows are neighbours; a repeated one adds 3 words, or as many as lie before the next repeated one.
    gram = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    counted = base.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_text", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.when(F.size("_words") >= 3, gram).otherwise(F.array().cast("array<bigint>")).alias("_grams"),
    )
    sifted = counted.withColumn("_placed", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("_grams")
    twice = sifted.withColumn("_at", F.sort_array(F.filter(
        F.transform("_placed", lambda x, i: F.when(
            (F.get("_placed", i - 1)["g"] == x["g"]) | (F.get("_placed", i + 1)["g"] == x["g"]), x["i"])),
        lambda i: i.isNotNull()))).drop("_placed")
    spans = F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - i, F.lit(3))))
    return twice.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_at")


def ratios(stats: DataFrame) -> DataFrame:
    """The statistics that rules may use: shares, so that they don't depend on a text's length, and the length."""
    per_word, per_char, per_line = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return stats.withColumns({
        "r_words": F.col("n_words").cast("double"),
        "r_mean_word": F.col("word_chars") / per_word,
        "r_symbols": F.col("n_symbols") / per_word,
        "r_dup_lines": F.col("n_dup_lines") / per_line,
        "r_repeats": F.col("n_repeat_words") / per_word,
        "r_upper": F.col("n_upper") / per_char,
        "r_digits": F.col("n_digits") / per_char,
        "r_distinct": F.col("n_distinct") / per_word,
        "r_line_words": F.col("n_words") / per_line,
    })


RATIOS = ("r_words", "r_mean_word", "r_symbols", "r_dup_lines", "r_repeats", "r_upper", "r_digits", "r_distinct", "r_line_words")


def learn(rows: Sequence[Sequence[float]], bad: Sequence[int], names: Sequence[str] = RATIOS, precision: float = PRECISION, support: int = SUPPORT, most_rules: int = MOST_RULES) -> list[list[Condition]]:
    """Decision list over a bounded sample: rules in order, each a conjunction that says "low quality".

    Every third row prunes, the others grow. Ties go to the statistic and threshold that come first.
    """
    cuts = []
    for k in range(len(names)):
        values = sorted({r[k] for r in rows})
        cuts.append([values[(len(values) - 1) * q // BINS] for q in range(1, BINS)] if len(values) > BINS else values[:-1])
        cuts[-1] = sorted(set(cuts[-1]))
    holds = lambda r, c: (r[c[0]] > c[2]) == c[1]
    left, rules = list(range(len(rows))), []
    while len(rules) < most_rules:
        grow = [i for i in left if i % 3]
        rule: list[tuple[int, bool, float]] = []
        covered = grow
        while len(rule) < MOST_CONDITIONS:
            p0 = sum(bad[i] for i in covered)
            if not p0 or p0 == len(covered):
                break
            before = math.log2(p0 / len(covered))
            best = (1e-9, None)
            for k, thresholds in enumerate(cuts):
                order = sorted(covered, key=lambda i, k=k: rows[i][k])
                at = p_low = 0
                for t in thresholds:
                    while at < len(order) and rows[order[at]][k] <= t:
                        p_low += bad[order[at]]
                        at += 1
                    for above, p, n in ((False, p_low, at), (True, p0 - p_low, len(order) - at)):
                        if p >= support and (gain := p * (math.log2(p / n) - before)) > best[0]:
                            best = (gain, (k, above, t))
            if best[1] is None:
                break
            rule.append(best[1])
            covered = [i for i in covered if holds(rows[i], best[1])]
        prune = [i for i in left if not i % 3]

        def worth(r: list) -> tuple[float, int]:
            hit = [i for i in prune if all(holds(rows[i], c) for c in r)]
            p = sum(bad[i] for i in hit)
            return (2 * p - len(hit)) / (len(hit) or 1), p

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [i for i in left if rule and all(holds(rows[i], c) for c in rule)]
        p = sum(bad[i] for i in hit)
        if len(hit) < support or p < precision * len(hit) or worth(rule)[0] < 2 * precision - 1:
            break
        rules.append([Condition(names[k], above, t) for k, above, t in rule])
        gone = set(hit)
        left = [i for i in left if i not in gone]
    return rules


def verdict(rules: Sequence[Sequence[Condition]]) -> tuple[Column, Column]:
    """(kept, number of the deciding rule or null): the ordered conditional expressions that a list stands for."""
    kept, which = F.lit(True), F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules))):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        kept, which = F.when(test, False).otherwise(kept), F.when(test, n).otherwise(which)
    return kept, which


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, base_failed, kept and deciding rule of every document.

    Labels join by doc_id; null labels and ids teach nothing, repeated ones count each. The labels are drawn before the
    documents are looked up, so the statistics of the drawn ones only are gathered. Without any label, or without a
    precise rule, the method keeps what the base rules keep. An empty table gives an empty result; only doc_id and text
    are read, so other columns can't clash. Texts of any length are counted whole.
    """
    stats = ratios(stored(statistics(docs)))
    drawn = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    # At most sample_rows rows of two numbers.
    sample = stats.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "n_words").select(*RATIOS, "quality").collect()
    rules = learn([tuple(r)[:-1] for r in sample], [1 - min(1, r["quality"]) for r in sample])
    kept, which = verdict(rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "kept": F.when(failed, False).otherwise(kept), "rule": which}).drop(*RATIOS)


def op8_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
