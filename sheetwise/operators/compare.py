"""Version comparison: every row of a new and an old revision gets a status, its changes and both pages.

Statuses follow a fixed order of tests: a recorded conflict on either side, then a key that isn't unique, are for
review; then missing rows are added or removed; then fields decide between changed and unchanged. What a key has on
either side is aggregated (partially before the shuffle, so a key that half the rows share costs one row a task) and
joined back to the rows with care for such keys; no pair of rows with the same repeated key is ever formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.text import identity_text, numeric_value, shown, with_starting, without_starting
from sheetwise.operators.skew import with_figures

STATUS_LABELS = {"changed": "變更", "added": "新增", "removed": "移除", "review": "待確認", "unchanged": "未變更", "uncompared": "未比對"}


@dataclass
class Comparison:
    """`rows`: all new rows, then the removed old ones; `candidates`: for review, the old rows of each repeated key, once."""

    rows: DataFrame
    candidates: DataFrame


def identity(columns: Sequence[str], normalise=identity_text) -> Column:
    """Composite key: a struct, so no separator can be forged."""
    return F.struct(*[normalise(F.col(c)).alias(f"k{i}") for i, c in enumerate(columns)])


def compare(new: DataFrame, old: DataFrame, keys: Sequence[str], fields: Mapping[str, str] | Sequence[str], order: str, page: str | None = None, conflict: str | None = None, normalise=identity_text, same=None, by_kind: tuple[str, Mapping[str, Mapping[str, str]]] | None = None) -> Comparison:
    """Compare two revisions. `fields` maps labels to columns, compared as text with null equal to empty.

    `order` gives the document order of rows; the first old row of a key is the one compared with. `same` changes how a
    field's text is compared (for example without blanks). `by_kind` (column, kind: further fields) names fields that are
    compared in new rows of that kind only.
    """
    named = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    wanted = [(label, c, F.lit(True)) for label, c in named.items()]
    for kind, more in (by_kind[1] if by_kind else {}).items():
        wanted += [(label, c, F.col(by_kind[0]).eqNullSafe(F.lit(kind))) for label, c in more.items()]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bare = same or (lambda c: c)
    both = new.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True)), allowMissingColumns=True).withColumn("_key", identity(keys, normalise))
    own = F.when(F.col(conflict) != "", F.col(conflict)) if conflict else F.lit(None).cast("string")
    old_page = F.col(page).cast("string") if page else F.lit(None).cast("string")
    first = F.struct(F.col(order), *[text(c).alias(f"f{i}") for i, (_, c, _) in enumerate(wanted)], old_page.alias("page"))
    figures = both.groupBy("_key").agg(
        F.count_if(~F.col("_old")).alias("_n_new"), F.count_if(F.col("_old")).alias("_n_old"), F.min(F.when(F.col("_old"), first)).alias("_first"),
        F.min(F.when(F.col("_old") & own.isNotNull(), F.struct(F.col(order), own.alias("why")))).alias("_odd"), F.max((~F.col("_old") & own.isNull()).cast("int")).alias("_plain"), F.count("*").alias("_n"))
    both = with_figures(both, figures, "_key", "_n")
    several = (F.col("_n_new") > 1) | (F.col("_n_old") > 1)
    differs = F.array(*[F.struct(F.lit(label).alias("field"), F.col(f"_first.f{i}").alias("old"), text(c).alias("new"), applies.alias("applies")) for i, (label, c, applies) in enumerate(wanted)])
    changed = F.transform(F.filter(differs, lambda x: x["applies"] & (bare(x["old"]) != bare(x["new"]))), lambda x: F.struct(x["field"].alias("field"), x["old"].alias("old"), x["new"].alias("new")))
    inherited = F.coalesce(own, F.col("_odd.why"))
    status = (F.when(F.col("_old"), "removed").when(inherited.isNotNull() | several, "review")
              .when(F.col("_n_old") == 0, "added").when(F.size(changed) > 0, "changed").otherwise("unchanged"))
    judged = both.filter(~F.col("_old") | (F.col("_n_new") == 0)).withColumn("status", status)
    decided = F.col("status").isin("changed", "unchanged")
    judged = judged.withColumns({
        "changes": F.when(F.col("status") == "changed", changed).otherwise(F.array().cast("array<struct<field:string,old:string,new:string>>")),
        "old_page": F.when(decided, F.col("_first.page")), "conflict": F.when(F.col("status") != "removed", inherited)})
    doubtful = several & (F.col("_n_new") > 0) & F.col("_odd").isNull() & (F.col("_plain") == 1)
    scratch = ("_old", "_n_new", "_n_old", "_first", "_odd", "_plain", "_n")
    return Comparison(judged.drop(*scratch), both.filter(F.col("_old") & doubtful).select(*old.columns, "_key"))


#: Further fields of instruction rows among specification rows (fixed labels).
COMMAND_FIELDS = {"3/4 byte address": "address", "Dummy": "dummy"}


def compare_specs(new: DataFrame, old: DataFrame, keys: Sequence[str], fields: Mapping[str, str] | Sequence[str], order: str, page: str | None = None) -> Comparison:
    """Compare specification rows whose limits may hold for aligned and any starting addresses alike (`start`, stated in `condition` too).

    Such rows are compared as two, and two that end alike become one again: same identity but for the start, limits,
    unit, status, changes and old page, in MHz, and not under review. The pair stands in the place of its first row.
    Instruction rows (`spec_type` Command) are also compared by address and dummy clocks, where there are such columns.
    """
    told = {label: c for label, c in COMMAND_FIELDS.items() if c in new.columns and c in old.columns}
    by_kind = ("spec_type", {"Command": told}) if told and "spec_type" in new.columns else None
    spread = lambda df: expand_pairs(df, "start").withColumn("condition", F.when(F.col("start").isin("Aligned", "Any"), with_starting(F.col("condition"), F.col("start"))).otherwise(F.col("condition")))
    found = compare(spread(new), spread(old), keys, fields, order, page=page, by_kind=by_kind)
    rows = found.rows.withColumns({"_bare": without_starting(F.col("condition")), "_order": F.struct(F.col(order), F.col("start"))})
    foldable = F.col("start").isin("Aligned", "Any") & (F.col("unit") == "MHz") & numeric_value(F.col("max").cast("string")).isNotNull() & (F.col("status") != "review")
    same = [c for c in rows.columns if c not in ("_key", "_order", "condition", "start", order)]
    folded = fold_pairs(rows.filter(F.coalesce(foldable, F.lit(False))), same, "start", "_order")
    folded = folded.withColumn("condition", F.when(F.col("start") == "Aligned/Any", with_starting(F.col("condition"), F.lit("Aligned/Any"))).otherwise(F.col("condition")))
    return Comparison(folded.unionByName(rows.filter(~F.coalesce(foldable, F.lit(False)))).drop("_bare", "_order"), found.candidates)


def compare_commands(new: DataFrame, old: DataFrame, order: str = "command_id") -> Comparison:
    """Instruction comparison: key (mode, command, opcode, setting); four fields, compared without any blanks."""
    return compare(new, old, ("mode", "command", "opcode", "setting"), ("address", "dummy", "data", "extra"), order, page="page", same=lambda c: F.regexp_replace(c, r"\s+", ""))


def change_text(changes: Column) -> Column:
    """field：old → new, joined; blanks are named."""
    return F.array_join(F.transform(changes, lambda x: F.concat(x["field"], F.lit("："), shown(x["old"]), F.lit(" → "), shown(x["new"]))), "；")


def status_counts(rows: DataFrame) -> DataFrame:
    """One row: rows that still exist, changed, added, removed and review counts."""
    return rows.agg(
        F.count_if(F.col("status") != "removed").alias("n_rows"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("changed", "added", "removed", "review", "unchanged")])


def report_counts(rows: DataFrame, reviews: DataFrame, by: Sequence[str], product: str = "product") -> DataFrame:
    """(by, rows that still exist, products, changed, added, removed, items for review): the figures above a comparison."""
    status = lambda s: F.count_if(F.col("status") == s)
    counted = rows.groupBy(*by).agg(F.count_if(F.col("status") != "removed").alias("n_rows"), F.count_distinct(F.when(F.col("status") != "removed", F.col(product))).alias("n_products"), *[status(s).alias(f"n_{s}") for s in ("changed", "added", "removed")])
    items = reviews.groupBy(*by).agg(F.count("*").alias("n_review"))
    return counted.join(items, list(by), "left").withColumn("n_review", F.coalesce("n_review", F.lit(0)))


def fold_pairs(rows: DataFrame, keys: Sequence[str], variant: str, order: str, merged: str = "Aligned/Any") -> DataFrame:
    """Two rows that agree in `keys` and differ in `variant` become one, with variant `merged`, in the first's place.

    Groups of any other size stay as they are.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct(variant).alias("_kinds"), F.min(order).alias("_first"))
    match = [rows[k].eqNullSafe(groups[k]) for k in keys]
    joined = rows.join(groups, match).select(rows["*"], "_n", "_kinds", "_first")
    pair = (F.col("_n") == 2) & (F.col("_kinds") == 2)
    return joined.filter(~pair | (F.col(order) == F.col("_first"))).withColumn(variant, F.when(pair, merged).otherwise(F.col(variant))).drop("_n", "_kinds", "_first")


def expand_pairs(rows: DataFrame, variant: str, merged: str = "Aligned/Any", kinds: Sequence[str] = ("Aligned", "Any")) -> DataFrame:
    """The inverse of folding: a merged row becomes one row per kind."""
    return rows.withColumn(variant, F.explode(F.when(F.col(variant) == merged, F.array(*map(F.lit, kinds))).otherwise(F.array(variant))))
