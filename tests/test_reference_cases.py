"""Behaviour of the functions and operators on small literal cases."""

import itertools
import random
import re
import zipfile
from io import BytesIO

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetwise.functions import text as t
from sheetwise.operators import compare as cmp
from sheetwise.operators import documents as doc
from sheetwise.operators import geometry, narrative as nar
from sheetwise.sources import workbook


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


CASES = [
    (t.clean, "  a \t\n b" + chr(0x3000) + "c" + chr(0xA0), "a b c"),
    (t.clean, None, ""),
    (t.strip_notes, "Erase (11, 14) time(2)", "Erase time"),
    (t.strip_dummy_notes, "8 (Def.)(3)", "8"),
    (t.normalize_opcode, "6bh, 6CH/6bh(1)", "6Bh/6Ch"),
    (t.identity_text, "Read (9Fh / 05h)  X", "read (05h/9fh) x"),
    (t.identity_text, "VCC = (1)", "vcc = (1)"),
    (t.interface_mode, "SPI-DDR；4-4-4（STR）", "SPI_DTR；QPI（STR）"),
    (t.limit_text, "− 1,200.0", "-1200"),
    (t.limit_text, "±2", "±2"),
    (t.limit_text, "5d", "5d"),
    (t.address_key, "A23–A16, A15-A8, A7-A0", "3"),
    (t.address_key, "3-/4-byte Address", "3/4"),
    (t.command_name, "Fast Read Dual I / O with 4-Byte Address", "fastreaddualio"),
    (t.related_interface, "Program（1-1-1, 4-4-4）", "Both"),
    (t.expand_shorthand, "ab12q32/64rw", "AB12Q32RW AB12Q64RW"),
    (t.product_tokens, "AB25Q64RW-DTR and XY1, AB25Q64RW", ["AB25Q64RW"]),
    (t.codes, "(0bh / 9Ch) 0B", ["0Bh", "9Ch"]),
    (t.split_sentences, "See Fig. 3 for it. The next one! ok", ["See Fig. 3 for it.", "The next one! ok"]),
    (t.split_sentences, "It is '1'.If set, go. Done", ["It is '1'.", "If set, go.", "Done"]),
    (t.ends_sentence, 'it is so."', True),
    (t.ends_sentence, "see Fig.", False),
    (t.normalize_text, "ﬁ ²x " + chr(0x201C) + "y" + chr(0x201D) + " a—b", 'fi 2x "y" a-b'),
    (t.without_starting, "VCC; Starting Address: Any；x", "VCC; x"),
]


@pytest.mark.parametrize("function,given,wanted", CASES)
def test_text(spark, function, given, wanted):
    assert value(spark, function(F.lit(given).cast("string"))) == wanted


def test_products(spark):
    known = F.array(*map(F.lit, ("AB25Q16RW", "AB25Q32RW", "AB25Q64RW", "CD25Q32RW")))
    assert value(spark, t.products_from_text(F.lit("AB25Q16RW–64RW only"), known)) == ["AB25Q16RW", "AB25Q32RW", "AB25Q64RW"]
    assert value(spark, t.products_from_text(F.lit("nothing"), known)) == ["AB25Q16RW", "AB25Q32RW", "AB25Q64RW", "CD25Q32RW"]
    assert value(spark, t.products_from_text(F.lit("AB25Q16RW-99ZZ"), known, known_only=True)) == []
    assert value(spark, t.strip_products(F.lit("AB25Q16RW-DTR, fast"), known)) == "fast"


def test_page_list(spark):
    assert value(spark, t.page_list(F.lit("3, 07,3"))) == [3, 7] and value(spark, t.page_list(F.lit(" "))) == []
    with pytest.raises(Exception, match="positive whole numbers"):
        value(spark, t.page_list(F.lit("3,x")))


def test_compare_order_of_tests(spark):
    schema = "ord int, k string, v string, why string, page int"
    new = spark.createDataFrame([(1, "a", "1", "", 5), (2, "b", "1", "", 5), (3, "c", "1", "odd", 5), (4, "d", "1", "", 5), (5, "d", "2", "", 5), (6, "e", None, "", 5), (7, "f", "1", "", 5)], schema)
    old = spark.createDataFrame([(1, "A ", "1", "", 9), (2, "c", "1", "", 9), (3, "d", "1", "", 9), (4, "e", "", "", 9), (5, "f", "2", "", 9), (6, "g", "1", "", 9), (7, "g", "1", "", 9)], schema)
    got = cmp.compare(new, old, ["k"], ["v"], "ord", page="page", conflict="why")
    assert sorted((r["k"], r["status"], r["old_page"]) for r in got.rows.collect()) == sorted([
        ("a", "unchanged", "9"), ("b", "added", None), ("c", "review", None), ("d", "review", None), ("d", "review", None), ("e", "unchanged", "9"), ("f", "changed", "9"), ("g", "removed", None), ("g", "removed", None)], key=str)
    assert [r["k"] for r in got.candidates.collect()] == ["d"]
    assert {r["status"] for r in cmp.compare(new.limit(2), new.limit(2), ["k"], ["v"], "ord").rows.collect()} == {"unchanged"}


def test_word_diff():
    kinds = lambda old, new: [(c["t"], c["v"] or (c["o"], c["n"])) for c in nar.diff_words(old, new)]
    assert kinds("a b c", "a x c") == [("eq", "a "), ("del", "b "), ("ins", "x "), ("eq", "c")]
    assert kinds("the W25Q64JV part", "the W25Q32RW part") == [("eq", "the "), ("part", ("W25Q64JV ", "W25Q32RW ")), ("eq", "part")]
    assert nar.pair("double-buffering on", "doublebuffering on")[0] == "same"
    for old, new in (("", "x y"), ("x y", ""), ("one two three", "zero one three four")):
        chunks = nar.diff_words(old, new)
        assert "".join(c["v"] for c in chunks if c["t"] in ("eq", "ins")).split() == new.split()


def plain_common(a, b):
    """Length of the longest common subsequence, by the plain table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_word_diff_against_plain_table():
    """As many words are kept as can be, and both texts can be read off the chunks."""
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(2))
        chunks = nar.diff_words(" ".join(a), " ".join(b))
        side = lambda *kinds: "".join(c["v"] for c in chunks if c["t"] in kinds).split()
        assert side("eq", "ins") == b and len(side("eq")) == plain_common(a, b)
        assert "".join(side("eq", "del")) == "".join(a)


def likeness(old, new):
    """Dice similarity of all old with all new texts by their word sets; 1 where both have none."""
    a, b = (list(map(nar.word_kinds, side)) for side in (old, new))
    return np.array([[2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0 for y in b] for x in a]).reshape(len(a), len(b))


def test_alignment_against_all_choices():
    """Between exact anchors no other choice of pairs in order has more likeness in all."""
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice(["red", "green", "blue", "pink", "grey"]) + str(rng.randint(0, 1)) for _ in range(4))
    for _ in range(60):
        old, new = [say() for _ in range(rng.randint(0, 4))], [say() for _ in range(rng.randint(0, 4))]
        if set(map(nar.masked_key, old)) & set(map(nar.masked_key, new)):
            continue
        like = likeness(old, new)
        got = [p for p in nar.align(old, new) if min(p) >= 0]
        best = max(sum(like[i, j] for i, j in zip(x, y)) for n in range(min(len(old), len(new)) + 1) for x in itertools.combinations(range(len(old)), n) for y in itertools.combinations(range(len(new)), n) if all(like[i, j] >= nar.ALIGN for i, j in zip(x, y)))
        assert sum(like[i, j] for i, j in got) == pytest.approx(best) and got == sorted(got)


def test_alignment():
    assert nar.align(["same one", "gone away now", "the last row is here"], ["same one", "the last line is here", "brand new"]) == [(0, 0), (1, -1), (2, 1), (-1, 2)]
    merged = nar.merge_split([("It is set. More text follows", "It is set."), (None, "More text follows")])
    assert [r[2] for r in merged] == ["same"]


def test_tables():
    edges = [("h", y, 0.0, 100.0) for y in (0.0, 20.0, 40.0)] + [("v", x, 0.0, 40.0) for x in (0.0, 50.0, 100.0)]
    cells = geometry.find_cells(edges)
    assert sorted(cells) == [(0, 0, 50, 20), (0, 20, 50, 40), (50, 0, 100, 20), (50, 20, 100, 40)] and len(geometry.group_tables(cells)) == 1
    assert geometry.merge_edges([("h", 0, 0, 10), ("h", 1.5, 12, 20), ("h", 3, 0, 5)]) == [("h", 0.75, 0.0, 20.0), ("h", 3.0, 0.0, 5.0)]


def test_workbook(spark):
    df = spark.createDataFrame([("=1+1", 2.0, None), ("<&>" + chr(1), 3.0, "x")], "a string, b double, c string")
    with zipfile.ZipFile(BytesIO(workbook.workbook({"One": df, "說明": df.limit(1)}))) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "<f>" not in sheet and '<t xml:space="preserve">=1+1</t>' in sheet and "&lt;&amp;&gt;" in sheet and "<v>2.0</v>" in sheet and len(z.namelist()) == 6


def test_curves_and_thin_fills():
    draw = lambda *ops: geometry.rulings(pd.DataFrame(ops, columns=["op", "args"]), (1, 0, 0, 1, 0, 0))
    assert draw(("stroke", [0, 0, 0, 2, 10, 5, 40, 5, 50, 0])) == []  # a curve between two level points is no line
    assert draw(("stroke", [0, 0, 0, 2, 10, 5, 40, 5, 50, 0, 1, 90, 0])) == [("h", 0.0, 50.0, 90.0)]
    assert draw(("fill", [0, 0, 0, 1, 20, 0, 1, 40, 0, 1, 40, 1, 1, 20, 1, 1, 0, 1, 4])) == [("h", 0.5, 0.0, 40.0)]
    assert draw(("fill", [0, 0, 0, 1, 40, 0, 1, 40, 9, 1, 0, 9, 4])) == []


def test_glued_abbreviations(spark):
    assert value(spark, t.split_sentences(F.lit("see Fig.Ab for it.Then go"))) == ["see Fig.Ab for it.", "Then go"]


def test_sentences_keep_their_digits(spark):
    assert value(spark, t.split_sentences(F.lit("0 of 10. Then 1 of 11.  And 2 of 20"))) == ["0 of 10.", "Then 1 of 11.", "And 2 of 20"]


def test_bare_numbers_beside_footers(spark):
    """Digits alone go where a known footer stands low on the same page, and stay elsewhere."""
    rows = [(1, 1, 95.0, "Page 1"), (1, 2, 85.0, "Page 2"), (1, 2, 86.0, "- 2"), (1, 3, 86.0, "3"), (1, 3, 50.0, "44")]
    lines = spark.createDataFrame(rows, "doc int, page int, y double, text string").withColumn("height", F.lit(100.0))
    assert sorted(r["text"] for r in doc.without_footers(lines, ["doc"], "y", "height", page="page").collect()) == ["3", "44"]
    assert value(spark, doc.printed_page(F.lit(7), F.lit("Rev 3 of this"), loose=True)) == 3 and value(spark, doc.printed_page(F.lit(7), F.lit("Rev 3 of this"))) == 7


def test_footers_in_page_order(spark):
    lines = spark.createDataFrame([(1, 1, 85.0, "Page 1"), (1, 2, 95.0, "Page 2"), (1, 3, 85.0, "Page 3")], "doc int, page int, y double, text string").withColumn("height", F.lit(100.0))
    ordered, all_pages = (sorted(r["page"] for r in doc.without_footers(lines, ["doc"], "y", "height", page=p).collect()) for p in ("page", None))
    assert ordered == [1] and all_pages == []


def plain_pairs(old, new):
    """Every title held against every other one: equal keys in order, then the most alike, ties in new and old order."""
    key = lambda t: re.sub("[^a-z0-9⟨⟩]+", "", nar.masked(t).lower())
    found, free = [-1] * len(new), list(range(len(old)))
    for j, (number, title) in enumerate(new):
        same = [i for i in free if key(old[i][1]) == key(title)]
        if same:
            found[j] = next((i for i in same if old[i][0] == number), same[0])
            free.remove(found[j])
    like = likeness([t for _, t in old], [t for _, t in new])
    offers = []
    for j in (j for j in range(len(new)) if found[j] < 0):
        for i in free:
            equal = old[i][0] == new[j][0] != ""
            if like[i, j] >= nar.TITLES or (equal and like[i, j] >= nar.NUMBERED):
                offers.append((-(like[i, j] + nar.BONUS * equal), j, i))
    for _, j, i in sorted(offers):
        if found[j] < 0 and i in free:
            found[j] = i
            free.remove(i)
    return found


def test_section_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["read", "write", "mode", "table", "erase", "clock", "W25Q128JV", "說明", "–"])
    made, rows = {}, []
    for d in range(120):
        sides = [[(rng.choice(["", "1", "2", "3", "4"]), " ".join(word() for _ in range(rng.randint(1, 4)))) for _ in range(rng.randint(0, 9))] for _ in range(2)]
        made[d] = sides
        rows += [(d, s, k, n, t) for s, side in zip(("old", "new"), sides) for k, (n, t) in enumerate(side)]
    got = nar.paired_sections(spark.createDataFrame(rows, "doc int, side string, ord int, number string, title string"), ["doc"]).collect()
    for d, (old, new) in made.items():
        wanted = plain_pairs(old, new)
        own = {(r["new_idx"], r["old_idx"]) for r in got if r["doc"] == d}
        assert own == {(j, i if i >= 0 else None) for j, i in enumerate(wanted)} | {(None, i) for i in range(len(old)) if i not in wanted}, (old, new)


def test_reflow_against_plain_joining(spark):
    """Pieces of a section joined one after the other in Python: the same paragraphs before sentences are cut."""
    rng = random.Random(5)
    rows = [(s, k, " ".join(rng.choice(["Alpha", "beta", "gamma.", "(delta", "re-", "Epsilon:"]) for _ in range(rng.randint(1, 3))), rng.choice(["text"] * 4 + ["list"]), 1 + k // 3) for s in range(8) for k in range(9)]
    ends = lambda text: text[-1] in ".:"
    wanted = {}
    for s, _, text, kind, page in rows:
        done = wanted.setdefault(s, [])
        last = done[-1] if done else None
        if last and last[1] == kind == "text" and not ends(last[0]) and (last[2] != page or text[0].islower() or text[0] == "("):
            glued = last[0][:-1] + text if last[0].endswith("re-") and text[0].islower() else f"{last[0]} {text}"
            done[-1] = (glued, kind, page)
        else:
            done.append((text, kind, page))
    got = {}
    for r in doc.reflow(spark.createDataFrame(rows, "section int, ord int, text string, kind string, page int"), ["section"], "ord").orderBy("section", "paragraph", "sentence").collect():
        got.setdefault(r["section"], {}).setdefault(r["paragraph"], []).append(r["text"])
    assert {s: [" ".join(p) for _, p in sorted(paragraphs.items())] for s, paragraphs in got.items()} == {s: [t for t, _, _ in done] for s, done in wanted.items()}
