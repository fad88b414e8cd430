"""Page-level operators of a document: contents entries, running footers, notes, catalogues, page choice, paragraphs, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.text import BLANK, END, START, clean, ends_sentence, join_wrapped, product_tokens, split_sentences, strip_notes, title_key, unwrap
from sheetwise.operators.cuts import dealt

LEADER = r"\.{6,}|(?:\.\s){5,}"
#: Contents lines that make a page a contents page; length from which paragraphs no longer join.
LEAST_ENTRIES, LONG_PARAGRAPH = 4, 2400


def toc_entries(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines `3.1 Title ..... 12` with their number and title; other lines go."""
    pattern = r"^(\d{1,2}(?:\.\d{1,3}){0,5})\.?\s*(.*)$"
    title = F.regexp_replace(F.get(F.split(F.regexp_extract(text, pattern, 2), LEADER), F.lit(0)), r"[.\s]*\d*\s*$", "")
    return lines.withColumns({"number": F.regexp_extract(text, pattern, 1), "title": F.trim(title)}).filter((F.col("number") != "") & F.col("title").rlike("[A-Za-z]"))


def contents_pages(lines: DataFrame, page: Sequence[str], text: str = "text") -> DataFrame:
    """Pages with enough dotted lines."""
    return lines.groupBy(*page).agg(F.count_if(F.col(text).rlike(LEADER)).alias("n_leaders")).filter(F.col("n_leaders") >= LEAST_ENTRIES)


def listed_headings(headings: DataFrame, entries: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Headings (number, title) that the contents list: equal numbers, and a title of three letters or more that a listed one begins with."""
    listed = entries.select(*doc, "number", title_key(F.col("title")).alias("_listed")).distinct()
    own = headings.withColumn("_own", title_key(F.col("title")))
    return own.join(listed, [*doc, "number"]).filter((F.length("_own") >= 3) & F.startswith("_listed", "_own")).drop("_own").withColumnRenamed("_listed", "listed_title")


def footer_key(text: Column) -> Column:
    """A running footer without its numbers."""
    return F.regexp_replace(unwrap(clean(text)), r"\d+", "#")


def without_footers(lines: DataFrame, doc: Sequence[str], y: str, height: str, text: str = "text", page: str | None = None) -> DataFrame:
    """Lines of the body: inside the band, and low ones only if no footer seen in the document reads the same.

    With `page`, footers are learned in page order: those of later pages say nothing about earlier ones. On a page that
    has such a low footer, low lines of digits and dashes alone go with it.
    """
    share = F.col(y) / F.col(height)
    since = F.min(F.col(page) if page else F.lit(0)).alias("_since")
    footers = lines.filter(share >= 0.92).groupBy(*doc, footer_key(F.col(text)).alias("_f")).agg(since)
    body = lines.filter((share > 0.09) & (share < 0.92)).withColumn("_f", F.when(share > 0.8, footer_key(F.col(text))))
    known = body.join(dealt(footers), [*doc, "_f"], "left").withColumn("_is", F.col("_since").isNotNull() & (F.col("_since") <= (F.col(page) if page else F.lit(0))))
    bare = F.col("_f").isNotNull() & F.col(text).rlike(rf"^(?:-|\d|{BLANK})+$") & F.max("_is").over(Window.partitionBy(*doc, page)) if page else F.lit(False)
    return known.withColumn("_bare", bare).filter(~F.col("_is") & ~F.col("_bare")).drop("_f", "_since", "_is", "_bare")


def printed_page(page: Column, footer: Column, loose: bool = False) -> Column:
    """The number that a footer `- 14 -` prints, or the page's own; with `loose` also the first number before other text."""
    forms = [r"(?:^|\s)-\s*(\d+)\s*-"] + ([r"(?:^|\s)(\d+)\s+\D"] if loose else [])
    return F.coalesce(*[F.regexp_extract(footer, form, 1).try_cast("int") for form in forms], page)


def notes_for(rows: DataFrame, notes: DataFrame, keys: Sequence[str], page: str, note_page: str) -> DataFrame:
    """Each row with the notes of the first page from its own on that has the same keys: an as-of join without pairing pages.

    Rows and notes are put into one order, and the next note to come is carried backwards.
    """
    spare = [c for c in notes.columns if c not in (*keys, note_page)]
    left = rows.withColumns({"_p": F.col(page), "_k": F.lit(0), "_n": F.lit(None).cast(notes.select(F.struct(note_page, *spare)).schema[0].dataType)})
    right = notes.select(*keys, F.col(note_page).alias("_p"), F.lit(1).alias("_k"), F.struct(note_page, *spare).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col("_p"), F.col("_k")).rowsBetween(0, Window.unboundedFollowing)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_n", F.first("_n", ignorenulls=True).over(w))
    return both.filter("_k = 0").select(*rows.columns, *[F.col(f"_n.{c}").alias(c if c in spare else "note_page") for c in (note_page, *spare)])


def catalogue(pages: DataFrame, doc: Sequence[str], header: str, text: str, page: str) -> DataFrame:
    """(doc, products): models named in the headers of the first two pages, else in their text, else none."""
    front = pages.filter(F.col(page) <= 2)
    named = front.groupBy(*doc).agg(*[F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(page, product_tokens(F.col(c)).alias("m")))), lambda x: x["m"]))).alias(k) for c, k in ((header, "_h"), (text, "_t"))])
    return named.select(*doc, F.when(F.size("_h") > 0, F.col("_h")).otherwise(F.col("_t")).alias("products"))


def strangers(pages: DataFrame, known: DataFrame, doc: Sequence[str], header: str, page: str) -> DataFrame:
    """(doc, product, pages): models in running headers that the document's catalogue lacks, with their pages in order."""
    seen = pages.select(*doc, page, F.explode(product_tokens(F.col(header))).alias("product"))
    listed = known.select(*doc, F.explode("products").alias("product"))
    return seen.join(listed, [*doc, "product"], "left_anti").groupBy(*doc, "product").agg(F.sort_array(F.collect_set(page)).alias("pages"))


def chosen_pages(pages: DataFrame, doc: Sequence[str], *tiers: Column) -> DataFrame:
    """Pages of the first tier that any page of the document satisfies."""
    w = Window.partitionBy(*doc)
    first = F.coalesce(*[F.when(F.max(t.cast("int")).over(w) == 1, i) for i, t in enumerate(tiers)])
    own = [F.when((F.col("_tier") == i) & t, True) for i, t in enumerate(tiers)]
    return pages.withColumn("_tier", first).filter(F.coalesce(*own, F.lit(False))).drop("_tier")


def may_hold_commands(text: Column) -> Column:
    """Pages worth searching for command tables: wording outside dotted contents lines."""
    body = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"\.{4,}|…{2,}")), "\n")
    return body.rlike(rf"(?i){START}opcode{END}|command code|instruction code|{START}byte\s*1{END}")


def factory_only(section: Column, group: Column) -> Column:
    scope = F.concat_ws(" ", section, group)
    return scope.rlike(rf"(?i){START}Factory[\s-]+(?:Mode|Only){END}") & ~scope.rlike(rf"(?i){START}User[\s-]+Mode{END}")


def command_limits(commands: DataFrame, extra: str = "extra") -> DataFrame:
    """A row per frequency limit in a command's further fields (start, limit, qualifier), with the other fields left in `rest`.

    Commands without a limit keep one row; a field that isn't a plain number stays in `rest`.
    """
    field = r"(?i)^\s*(Aligned|Any)\s+Address\s*\(\s*MHz\s*\)\s*:\s*(.*?)\s*$"
    number = r"^(\d+(?:\.\d+)?)(?:\s*(\([^()]+\)))?$"
    stated = lambda f: strip_notes(F.regexp_extract(f, field, 2))
    is_limit = lambda f: f.rlike(field) & stated(f).rlike(number)
    parts = F.split(F.coalesce(F.col(extra), F.lit("")), r";\s*")
    limits = F.transform(F.filter(parts, is_limit), lambda f: F.struct(
        F.when(F.lower(F.regexp_extract(f, field, 1)) == "aligned", "Aligned").otherwise("Any").alias("start"),
        F.regexp_extract(stated(f), number, 1).try_cast("double").alias("limit"),
        F.regexp_extract(stated(f), number, 2).alias("qualifier")))
    rest = F.array_join(F.filter(parts, lambda f: ~is_limit(f) & (f != "")), "; ")
    return commands.withColumns({"rest": rest, "_l": limits}).select("*", F.explode_outer("_l").alias("_x")).select(*commands.columns, "rest", "_x.start", "_x.limit", "_x.qualifier")


def mode_variants(commands: DataFrame, mode: str = "mode") -> DataFrame:
    """A row per protocol of a command that lists several; double-rate ones begin with a double-rate phase."""
    each = commands.withColumn(mode, F.explode(F.split(mode, "[；;]")))
    return each.withColumn("rate", F.when(F.trim(mode).rlike("^1-"), "SDR").when(F.trim(mode).rlike("^8d-"), "DDR"))


def reflow(paragraphs: DataFrame, section: Sequence[str], order: str) -> DataFrame:
    """Paragraphs (order, text, kind, page) of each section with wrapped pieces joined, then cut into sentences.

    A piece joins the one before if both are prose, that one doesn't end a sentence, neither is overlong, and it is on
    another page or begins in lower case.
    """
    piece = F.struct(F.col(order), clean(F.col("text")).alias("text"), F.col("kind"), F.col("page").cast("int").alias("page"), F.col("page").cast("int").alias("end_page"))
    pieces = F.filter(F.sort_array(F.collect_list(piece)), lambda p: p["text"] != "")
    kind = dict(paragraphs.dtypes)[order]
    start = F.array().cast(f"array<struct<{order}:{kind},text:string,kind:string,page:int,end_page:int>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        short = (F.length(last["text"]) <= LONG_PARAGRAPH) & (F.length(p["text"]) <= LONG_PARAGRAPH)
        joins = (last["kind"] == "text") & (p["kind"] == "text") & ~ends_sentence(last["text"]) & short & ((last["end_page"] != p["page"]) | p["text"].rlike("^[a-z(]"))
        both = F.struct(last[order].alias(order), join_wrapped(last["text"], p["text"]).alias("text"), last["kind"].alias("kind"), last["page"].alias("page"), p["end_page"].alias("end_page"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(p)))

    whole = paragraphs.groupBy(*section).agg(F.aggregate(pieces, start, step).alias("_p")).select(*section, F.posexplode("_p").alias("paragraph", "p"))
    sentences = F.when(F.col("p.kind") == "text", split_sentences(F.col("p.text"))).otherwise(F.array("p.text"))
    return whole.select(*section, "paragraph", "p.kind", "p.page", "p.end_page", F.posexplode(sentences).alias("sentence", "text"))


#: Titles that open, name and close the chapter of electrical characteristics (fixed patterns).
ELECTRICAL = r"(?i)^(?:(?:DC|AC|D\.C\.|A\.C\.)\s+)?Electrical Characteristics(?![A-Za-z0-9_])"
SPECIFIED = r"(?i)^(?:(?:DC|AC|D\.C\.|A\.C\.)\s+(?:Electrical Characteristics|Measurement Conditions)|IO Capacitance|Absolute Maximum Ratings|Operating Ranges|Recommended Operating|Power[- ]up|Program.*(?:Erase|Timing)|Erase.*Timing|Serial.*Frequency)"
CLOSING = r"(?i)^(?:PACKAGE|PACKAGING|ORDERING|REVISION HISTORY|REVISION TABLE|IMPORTANT NOTICE)(?![A-Za-z0-9_])"
#: Points from the top in which titles stand; the label before any.
TITLE_BAND, FIRST_LABEL = 180.0, "Electrical Characteristics"


def chapters(lines: DataFrame, doc: Sequence[str], page: str = "page") -> DataFrame:
    """(doc, page, label, in_chapter) of every page: what the title lines (y, text) up to its end say.

    Electrical titles open the chapter, closing titles and other chapters end it; after a closing title the rest of its
    page's titles isn't read. A continued electrical title leaves an electrical label as it is.
    """
    titles = lines.filter((F.col("y") < TITLE_BAND) & ~F.col("text").rlike(r"\.{3}|…")).withColumn("_t", F.regexp_replace("text", r"^\d+(?:\.\d+)*(?:\.\s*|\s+)", ""))
    closing, electrical = F.col("_t").rlike(CLOSING), F.col("_t").rlike(ELECTRICAL)
    own_page = Window.partitionBy(*doc, page).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    titles = titles.withColumn("_over", F.coalesce(F.max(closing.cast("int")).over(own_page), F.lit(0))).filter("_over = 0")
    other = F.col("text").rlike(r"^\d+\s+[A-Z][A-Z /-]+$")
    names = closing | electrical | F.col("_t").rlike(SPECIFIED) | other | F.col("text").rlike(r"^[1-9]\d*\.\d+\.?\s+[A-Z/]")
    again = ~closing & electrical & F.col("_t").rlike(r"(?i)cont[’']?d|continued")
    w = Window.partitionBy(*doc).orderBy(page, "y")
    before = F.coalesce(F.last(F.when(names, again | electrical), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    told = titles.withColumns({"_label": F.when(names & ~(again & before), F.col("_t")), "_in": F.when(closing, False).when(electrical, True).when(~F.col("_t").rlike(SPECIFIED) & other, False)})
    ends = told.groupBy(*doc, page).agg(F.max(F.when(F.col("_label").isNotNull(), F.struct("y", "_label"))).alias("_l"), F.max(F.when(F.col("_in").isNotNull(), F.struct("y", "_in"))).alias("_i"))
    all_pages = lines.select(*doc, page).distinct().join(ends, [*doc, page], "left")
    run = Window.partitionBy(*doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return all_pages.select(*doc, page, F.coalesce(F.last(F.col("_l._label"), ignorenulls=True).over(run), F.lit(FIRST_LABEL)).alias("label"), F.coalesce(F.last(F.col("_i._in"), ignorenulls=True).over(run), F.lit(False)).alias("in_chapter"))


def scoped_notes(rows: DataFrame, pages: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Rows (label, page, condition) with the notes that hold for them: of their page, else of the first later one of their label.

    Notes end where the next numbered section or the page's imprint begins. A factory-mode row takes the voltage range
    that its notes state for that mode.
    """
    noted = pages.filter(F.contains("text", F.lit("Notes:"))).select(*doc, "label", F.col("page").alias("_at"), F.regexp_extract("text", r"(?s)^.*?Notes:(.*)$", 1).alias("_notes"))
    found = notes_for(rows, noted, [*doc, "label"], "page", "_at")
    cut = lambda c, p: F.get(F.split(c, p), F.lit(0))
    notes = cut(cut(F.coalesce("_notes", F.lit("")), r"\n\s*[1-9]\d*\.\d+\s+"), "Publication Release Date:")
    range_of = F.regexp_extract(notes, r"(?is)Factory mode.*?VCC range from ([0-9.]+V\s+to\s+[0-9.]+V)", 1)
    condition = F.when(F.contains("condition", F.lit("Factory Mode")) & (range_of != ""), F.concat("condition", F.lit("; VCC = "), clean(range_of))).otherwise(F.col("condition"))
    return found.withColumns({"notes": notes, "condition": condition}).drop("_notes", "note_page")
