"""Decisions on pages, and the list of queries."""

import pytest
from pyspark.sql import functions as F

from quillrow.operators import pages


def test_turns(spark):
    rows = [(1, 0.0, 1.0), (1, 0.1, 1.0), (1, 1.0, 0.0), (2, 0.0, -1.0), (2, 0.0, -2.0), (3, 1.0, 0.0), (3, 0.0, 1.0), (4, 0.0, 1.0)]
    got = {r.page: r.turn for r in pages.turns(spark.createDataFrame(rows, "page int, dx double, dy double"), ["page"]).collect()}
    assert got == {1: "up", 2: "down", 3: "none", 4: "none"}
    x, y = pages.turned(F.col("x"), F.col("y"), F.col("t"))
    pts = spark.createDataFrame([(1.0, 2.0, "up"), (1.0, 2.0, "down"), (1.0, 2.0, "none")], "x double, y double, t string").select(x, y).collect()
    assert [tuple(r) for r in pts] == [(2.0, -1.0), (-2.0, 1.0), (1.0, 2.0)]


def test_jumbled(spark):
    rows = [(1, i, y) for i, y in enumerate((700.0, 100.0, 700.0, 100.0, 700.0))] + [(2, i, 700.0 - 60 * i) for i in range(6)]
    got = {r.page: r.jumbled for r in pages.jumbled(spark.createDataFrame(rows, "page int, i int, y double"), ["page"], "i").collect()}
    assert got == {1: True, 2: False}


def test_words(spark):
    words = spark.createDataFrame([(1, 3, "ab", 2.0), (1, 2, "ab", 5.0), (1, 1, "cd", 9.0), (1, 4, "ab", 5.0)], "doc_id int, page int, word string, gap double")
    misread = spark.createDataFrame([(1, "ab")], "doc_id int, word string")
    assert [r.page for r in pages.widest_first(words, misread).orderBy("place").collect()] == [2, 4, 3]
    docs = spark.createDataFrame([(1, "to tal and total and tot\nal"), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in pages.split_words(docs, ["total"]).collect()] == [(1, "total", 1, 1)]


def test_accuracy(spark):
    rows = pages.accuracy(spark.createDataFrame([("Total: 5", "total 5"), ("abc", None)], "truth string, said string")).collect()
    assert [r.accuracy for r in rows] == pytest.approx([1.0, 0.0])


def test_embedded(spark):
    got = spark.createDataFrame([(0, False), (2, True), (3, False)], "n int, p boolean").select(pages.embedded_message(F.col("n"), F.col("p"))).collect()
    assert [r[0] for r in got] == [None, "portfolio of 2 files", "3 attached files"]


def test_catalog():
    import __spark_entry__ as entry

    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and "compare_line_items" in known
    assert {k for k in known if not k.startswith("op") and k != "pipeline"} - set(sql) == {"irc_provisions", "doubled_words", "lines_of_runs", "table_regions"}  # folds, held against plain loops
