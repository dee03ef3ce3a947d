"""Package lanes, number formats, streaming and SQL functions."""

import io
import zipfile

import pytest

from quillrow.functions import sqlfuncs
from quillrow.operators import numberformats
from quillrow.sources import office
from quillrow.streaming import triage

W = 'xmlns:w="w" xmlns:r="r"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body, **more):
    return package(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **more})


def para(text, props="", run=""):
    return f"<w:p>{props}<w:r>{run}<w:t>{text}</w:t></w:r></w:p>"


def sheet(cells, state="visible", styles=""):
    parts = {
        "xl/workbook.xml": f'<workbook xmlns:r="r"><sheets><sheet name="Data" state="{state}" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>",
    }
    return package(**parts, **({"xl/styles.xml": styles} if styles else {}))


def test_docx():
    row = f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b|c')}</w:tc></w:tr></w:tbl>"
    got = office.convert(docx(para("Title", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + para("text") + row))
    assert (got["kind"], got["completeness"], got["error"]) == ("docx", "complete", None)
    assert got["markdown"] == "# Title\n\ntext\n\n| a | b\\|c |\n|---|---|\n"
    assert office.convert(docx(para("x", run="<w:rPr><w:vanish/></w:rPr>")))["warnings"] == ["hidden_content_preserved"]
    rels = '<Relationships><Relationship Id="a" TargetMode="External" Target="http://x"/></Relationships>'
    out = office.convert(docx(para("x"), **{"word/_rels/document.xml.rels": rels}))
    assert out["warnings"] == ["external_relationships_blocked"] and "http" not in out["markdown"]


@pytest.mark.parametrize(
    ("data", "code"),
    [(b"not a zip", "malformed"), (package(x="y"), "unrecognized"), (package(EncryptedPackage="x"), "encrypted"), (docx("", **{"word/vbaProject.bin": "x"}), "active_content_disabled"), (package(**{"word/document.xml": "<open"}), "malformed"), (sheet("", "hidden"), "incomplete_conversion"), (sheet('<c r="A1"><f>1+1</f></c>'), "incomplete_conversion")],
)
def test_refused(data, code):
    assert office.convert(data)["error"] == code and office.convert(data)["markdown"] is None


def test_xlsx():
    assert office.convert(sheet('<c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="C1"><f>1+1</f><v>2</v></c>'))["markdown"] == "## Data\n\n| Name |  | 2 |\n|---|---|---|\n"
    red = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="0;[Red]0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    assert office.convert(sheet('<c r="A1" s="1"><v>-5</v></c>', styles=red))["error"] == "incomplete_conversion"
    assert office.convert(sheet('<c r="A1" s="1"><v>5</v></c>', styles=red))["error"] is None


def test_others():
    slides = {"ppt/presentation.xml": '<p xmlns:r="r"><sldId id="1" r:id="a"/></p>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="a" Target="slides/s1.xml"/></Relationships>'}
    assert office.convert(package(**slides))["error"] == "incomplete_conversion"
    assert office.convert(package(**slides, **{"ppt/slides/s1.xml": "<s><p><t>Hi</t></p></s>"}))["markdown"] == "## Slide 1\n\nHi\n"
    odt = {"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<d xmlns:t="t"><body><text><t:h t:outline-level="2">H</t:h><t:p>x</t:p></text></body></d>'}
    assert office.convert(package(**odt))["markdown"] == "## H\n\nx\n"
    book = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="i" href="a.xhtml"/><itemref idref="i"/></p>'}
    assert office.convert(package(**book))["error"] == "incomplete_conversion"
    assert office.convert(package(**book, **{"o/a.xhtml": "<html><h1>One</h1><p>two</p></html>"}))["markdown"] == "# One\n\ntwo\n"


def test_converted(spark):
    rows = spark.createDataFrame([(1, bytearray(docx(para("x")))), (2, bytearray(b"zz")), (3, None)], "id int, content binary")
    got = {r.id: (r.kind, r.error) for r in office.converted(rows).collect()}
    assert got == {1: ("docx", None), 2: (None, "malformed"), 3: (None, "malformed")}


@pytest.mark.parametrize(("given", "want"), [((38, None, -5.0), (False, False)), ((0, "#,##0;[Red]#,##0", -5.0), (False, True)), ((0, ";;;", 5.0), (True, False)), ((0, ";;;", None), (True, False)), ((27, None, 1.0), (False, True)), ((0, '0;[Red]"CR"0', -3.0), (False, False)), ((0, "0.00;[Red]0.00", -0.001), (False, False)), ((0, 'open"', 1.0), (False, False))])
def test_formats(given, want):
    assert numberformats.loss(*given) == want


def test_shown_from():
    assert [numberformats.shown_from(x) for x in (0.5, 0.05, 5.0, 1e-200)] == [0, 1, -1, 99]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.csv", "a,b"), ("b.csv", "a,b"), ("c.md", "# x")):
        (tmp_path / "in" / name).write_text(text)
    got = []
    q = triage.each_batch(triage.triaged(triage.new_files(spark, str(tmp_path / "in"))), lambda df, n: got.extend(df.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(r.kind for r in got) == ["csv", "markdown"]


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT t.* FROM md_tables('| a | b |\n|---|---|\n| 1 | 2 |') t ORDER BY row, col").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]
    assert spark.sql("SELECT roman_number('ix'), doubled_runs('net sales net sales'), format_loss(27, NULL, 1.0D).misrendered").first()[:] == (9, ["net sales"], True)
    assert [r.label for r in spark.sql("SELECT label FROM provision_chain('(2)(A) If so')").collect()] == ["2", "A"]
