"""Forms, filings, statutes and text functions."""

import pytest
from pyspark.sql import functions as F

from quillrow.functions import text as T
from quillrow.operators import doubled, filings, forms, shown, statutes, tables


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize(
    ("text", "form", "confidence", "match"),
    [
        ("Form W-2\nwages", "w2", 1.0, "Form W-2"),
        ("x\n## W-2 Transcript", "w2", 0.95, "## W-2 Transcript"),
        ("FORM 1099 COMPOSITE and Form W-2", "form1099_composite", 1.0, "FORM 1099 COMPOSITE"),
        ("Schedule K-1 (Form 1065)", "k1_1065", 1.0, "Schedule K-1 (Form 1065"),
        ("SCHEDULE C (Form 1040) Profit or Loss From Business", "schedule_c", 1.0, "SCHEDULE C (Form 1040) Profit or Loss"),
        ("Form 1120-S", "form1120_s", 1.0, "Form 1120-S"),
        ("Interest Income", "form1099_int", 0.7, "Interest Income"),
        ("Schedule K-1\nForm 1065", "form1065", 1.0, "Form 1065"),
        ("nothing", "unknown", 0.0, ""),
        ("§" * 2500 + "Form W-2", "unknown", 0.0, ""),
        ("é" * 2495 + "Form W-2", "w2", 1.0, "Form W-2"),
        (None, "unknown", 0.0, ""),
    ],
)
def test_forms(spark, text, form, confidence, match):
    assert tuple(forms.identify(docs(spark, text)).first())[1:] == (form, confidence, match)


def test_byte_prefix(spark):
    cut = docs(spark, "aé§", "abc", "").select(T.byte_prefix(F.col("text"), 4).alias("p")).collect()
    assert [r.p for r in cut] == ["aé", "abc", ""]


def test_lines(spark):
    rows = T.lines(docs(spark, "a\né\n", "", "x\n\ny", None)).orderBy("doc_id", "ln").collect()
    assert [(r.doc_id, r.ln, r.raw, r.off) for r in rows] == [(0, 0, "a", 0), (0, 1, "é", 2), (2, 0, "x", 0), (2, 1, "", 2), (2, 2, "y", 3)]


def test_filings(spark):
    text = "intro\nPART I\nx\n## Item 1.    Business\r\nbody é\n|Item 1.|Business|\n**Item 7A. Market Risk**\nItem 8\n"
    rows = filings.sections(docs(spark, text)).orderBy("section").collect()
    assert [(r.name, r.item_number) for r in rows] == [("PART I", "PART_I"), ("Item 1 - Business", "1"), ("Item 7A - Market Risk**", "7A"), ("Item 8", "8")]
    assert rows[0].char_offset == 6 and rows[1].content.endswith("|Item 1.|Business|")
    assert rows[1].char_length == len(rows[1].content.encode())
    assert filings.sections(docs(spark, "no items", None)).count() == 0


STATUTE = """# SUBTITLE A
## CHAPTER 1
## §1398. Rules
**(a) General rule**
In these cases—
(i) first
(ii) second
(1) para (not list)
(A) sub
(2) of section 3121(d)
**(b)(1) Chained**
(2)(A) Two at once
## Editorial Notes
(c) not read
§1399. Next one
(a) In general
§1400. Repealed. Pub. L.
"""


def test_statutes(spark):
    own = docs(spark, STATUTE)
    sec = statutes.sections(own).orderBy("section").collect()
    assert [(r.section_number, r.title, r.repealed) for r in sec] == [("§1398", "Rules", False), ("§1399", "Next one", False), ("§1400", "Repealed. Pub. L.", True)]
    assert sec[0].notes.startswith("## Editorial Notes") and "(c) not read" in sec[0].notes and sec[1].notes is None
    assert STATUTE.encode()[sec[1].char_offset :].decode().startswith("§1399")
    got = [(r.section, r.label, r.title) for r in statutes.provisions(own).orderBy("section", "position").collect()]
    assert got == [(1, "(a)", "General rule"), (1, "(a)(i)", None), (1, "(a)(ii)", None), (1, "(a)(1)", None), (1, "(a)(1)(A)", None), (1, "(b)", None), (1, "(b)(1)", "Chained"), (1, "(b)(2)", None), (1, "(b)(2)(A)", None), (2, "(a)", None)]
    assert tuple(statutes.headings(own).first())[1:] == ("Subtitle A", "Chapter 1", None)


def test_depth():
    path = ["a", "1", "A", None, None, None, None]
    assert statutes.depth("i", path, False, True) == statutes.CLAUSE
    assert statutes.depth("b", path, False, True) == statutes.SUBSECTION
    assert statutes.depth("B", path, False, True) == statutes.SUBPARAGRAPH
    assert statutes.depth("aa", [*path[:3], "i", "I", None, None], False, True) == statutes.ITEM
    h = ["h", None, None, None, None, None, None]
    assert statutes.depth("i", h, False, True) == statutes.SUBSECTION
    assert statutes.depth("i", ["h", "1", "A", None, None, None, None], True, True) == statutes.CLAUSE
    assert statutes.depth("Ab", path, False, True) is None
    assert [statutes.roman(x) for x in ("iv", "IX", "iix", "abc")] == [4, 9, 8, None]


def test_tables(spark):
    text = "Name Total A 1,000.00\n\n| Name | Total |\n|---|---|\n| A | 1,000.00 |\n| B | 2.50 3.50 |\n\nLeft 7.25 and 2.50\n```\n| x | y |\n```\n"
    own = docs(spark, text)
    cells = tables.cells(own).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.cell, r.n_amounts) for r in cells] == [(0, 0, "Name", 0), (0, 1, "Total", 0), (1, 0, "A", 0), (1, 1, "1,000.00", 1), (2, 0, "B", 0), (2, 1, "2.50 3.50", 2)]
    assert [r.cell for r in tables.merged(own).collect()] == ["2.50 3.50"]
    assert tables.rows_repeated(own).count() == 1
    assert [r.amounts for r in tables.detached(own).collect()] == ["7.25"]


@pytest.mark.parametrize(("token", "good"), [("1,234.50", True), ("(1,234)", True), ("-$12.00", True), ("12,34.5", True), ("1234,567", False), (".50", False), ("12", False), ("5.0%", True)])
def test_amounts(spark, token, good):
    assert docs(spark, token).select(T.is_amount(F.col("text"))).first()[0] is good


def test_doubled(spark):
    assert [(r.pos, r.run) for r in doubled.at_once(docs(spark, "total total a a 5 5")).orderBy("pos").collect()] == [(0, "total"), (4, "5")]
    assert [(r.word, r.painted_once) for r in doubled.glyphs(docs(spark, "TToottaall aaaa book")).collect()] == [("TToottaall", "Total")]
    assert doubled.greedy("net sales net sales 5 5 a a") == ["net sales", "5"]


def test_shown(spark):
    items = spark.createDataFrame([(1, "Hel lo"), (2, "none"), (3, "")], "item_id long, text string")
    assert [tuple(r) for r in shown.shown(docs(spark, "**Hello** world", None), items).collect()] == [(0, 1)]
    asked = spark.createDataFrame([(0, "world"), (0, "absent"), (9, "x")], "doc_id long, value string")
    assert sorted(r.value for r in shown.unshown(asked, docs(spark, "hello world")).collect()) == ["absent", "x"]
    edge = spark.createDataFrame([("a120b", "12"), ("a12b", "12"), ("x.y", "x.y")], "t string, v string")
    assert [r[0] for r in edge.select(shown.edge_safe(F.col("t"), F.col("v"))).collect()] == [False, True, True]
