"""Delimited text, files, regions, findings, batches, and that every query runs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillrow.operators import batch, findings, layout, running
from quillrow.sources import files, tabular


@pytest.mark.parametrize(
    ("text", "delimiter"),
    [("a,b\n1,2", ","), ("a;b\n1,5;2\n3;4", ";"), ("a\tb\n1\t2", "\t"), ("alone\nwords", ","), ("a|b|c\n1|2|3", "|")],
)
def test_sniff(text, delimiter):
    assert tabular.sniffed(text) == delimiter


def test_csv_rules():
    assert tabular.to_markdown(b'\xef\xbb\xbfA,B\n"x|y","line\nbreak"\n\n1,""\n') == "| A | B |\n|---|---|\n| x\\|y | line break |\n| 1 |  |\n"
    for bad in (b'a,b\n"1,2\n', b"a,b\n1\n", b"a\0b", b"\xff\xfe", b'a,b\n"1"x,2\n', b""):
        with pytest.raises(tabular.Malformed):
            tabular.to_markdown(bad)
    with pytest.raises(tabular.Malformed, match="resource_limit"):
        tabular.to_markdown(b"a,b\n" + b"x" * (tabular.MOST_FIELD + 1) + b",2\n")


def test_scan_and_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", "<w/>")
    rows = {r.path.rsplit("/", 1)[1]: r.kind for r in files.scan(spark, str(tmp_path)).withColumn("kind", files.kind_of(F.col("content"), F.col("path"))).collect()}
    assert rows == {"a.csv": "csv", "b.docx": "zip"}
    members = spark.createDataFrame([(["word/document.xml"],), (["EncryptedPackage"],), (["xl/workbook.xml", "xl/vbaProject.bin"],), (["z"],)], "m array<string>")
    assert [r[0] for r in members.select(files.package_kind(F.col("m"))).collect()] == ["docx", "encrypted", "active_content_disabled", "unrecognized"]


def test_regions_and_bands(spark):
    items = spark.createDataFrame([(1, 1, 5.0, 90.0, "top"), (1, 1, 5.0, 10.0, "low"), (1, 1, 2.0, 90.0, "left"), (1, 2, 5.0, 5.0, "other")], "doc int, page int, x double, y double, text string")
    boxes = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 10.0, 100.0]), (1, 1, 1, [50.0, 50.0, 60.0, 60.0])], "doc int, page int, region int, box array<double>")
    rows = {r.region: (r.n_items, r.text) for r in layout.in_regions(items, boxes, "doc", 8.0).collect()}
    assert rows == {0: (3, "left top low"), 1: (0, "")}
    vals = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.9), (1, 3, 4.0), (2, 4, 0.1)], "k int, i int, v double")
    assert sorted((r.item_a, r.item_b) for r in layout.band_pairs(vals, ["k"], "v", 2.0, "i").collect()) == [(1, 2)]


def test_running(spark):
    rows = [(1, p, y, t) for p in range(1, 5) for y, t in ((800.0, f"Annual report 2024 {p}"), (400.0, f"body {p} text here"), (10.0, f"{p}"))]
    lines = spark.createDataFrame(rows, "doc_id int, page int, y double, text string")
    got = running.repeated(lines).collect()
    assert [(r.line_key, r.pages, r.first_page) for r in got] == [("Annual report 2024", 4, 1)] or [r.line_key for r in got] == ["Annual report"]
    kept = spark.createDataFrame([(1, "Annual report 2024\n")], "doc_id int, text string")
    assert running.lost(lines, spark.createDataFrame([(1, "nothing")], "doc_id int, text string")).count() >= 1
    assert running.lost(lines, kept).count() <= 1


def test_findings(spark):
    rows = [(1, 2, "invisible_text_read", "long enough", True), (1, 1, "invisible_text_read", "long enough", True), (1, 1, "invisible_text_read", "short", True), (1, 3, "form_values_misread", "v", True), (1, 3, "dense_content_unread", None, None)]
    made = findings.warnings(findings.decided(spark.createDataFrame(rows, "doc_id int, page int, code string, text string, shown boolean"))).orderBy("ord").collect()
    assert [(r.code, r.pages) for r in made] == [("invisible_text_read", [1, 2]), ("dense_content_unread", [3])]


def test_batch(spark):
    asked = spark.createDataFrame([(1, [7, 99, 7])], "r int, paths array<long>")
    done = spark.createDataFrame([(7, "ok")], "id long, what string")
    rows = batch.batch(asked, done, "id").orderBy("pos").collect()
    assert [(r.id, r.what, r.error) for r in rows] == [(7, "ok", None), (99, None, "not found"), (7, "ok", None)]
