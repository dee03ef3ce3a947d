"""Queries on positions against plain loops, and column functions on cases of their own."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quillrow.functions import markup as M
from quillrow.operators import glyphs, numberformats, running, statutes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "page", "want"),
    [
        ("Page 3 of 7", 3, ("Page # of #", True)), ("3/7", 1, ("#/#", True)), ("3/7/2025", 3, ("3/7/2025", False)), ("- 3 -", 3, ("- # -", True)), ("p. iv", 4, ("p. #", True)), ("Annual report 17", 17, ("Annual report #0#", False)),
        ("Annual report 1", 1, ("Annual report #0#", False)), ("Invoice 4500", 3, ("Invoice 4500", False)), ("May 3", 3, ("May 3", False)), ("Check No. 12", 12, ("Check No. 12", False)), ("10:32:07", 1, ("#:#:#", True)), ("page 25", 2, ("page #23#", True)),
        ("Smith | 5", 5, ("Smith | #0#", False)), ("p2.holder", 2, ("p#.holder", False)), ("Plan P2", 6, ("Plan P2", False)), ("", 1, ("", False)), ("xii", 10, ("#2#", True)), ("MIX", 5, ("MIX", False)), ("２ of 3", 1, ("２ of #2#", True)),
    ],
)
def test_masked(text, page, want):
    assert running.masked(text, page) == want


def test_masked_long_line():
    text = "word 5 " * 50_000
    assert running.masked(text, 9)[0].startswith("word 5 word")


def test_text_lines(spark):
    r = random.Random(3)
    runs = [(p, r.choice([10.0, 12.0, 40.0, 90.0, 200.0]), 700.0 - r.choice([0, 0.3, 1.0, 2.9, 3.0, 10.0, 10.4]), f"t{i}") for p in range(30) for i in range(r.randrange(12))]
    want = []
    for page, own in groupby(sorted(runs, key=lambda t: (t[0], -t[2], t[1], t[3])), key=lambda t: t[0]):
        lines = []
        for _, x, y, t in own:
            line = lines[-1] if lines else None
            apart = abs(line[0][1] - y) if line else 99
            if line and apart < 3 and not (apart > 0.5 and (abs(x - line[0][0]) < 5 or x < line[-1][0] - 10)):
                line.append((x, y, t))
            else:
                lines.append([(x, y, t)])
        want += [(page, x, y, t, i, n) for i, line in enumerate(lines) for n, (x, y, t) in enumerate(line)]
    df = spark.createDataFrame([*runs, (99, None, 1.0, "no place")], "page long, x double, y double, text string")
    assert sorted(map(tuple, glyphs.text_lines(df, ["page"]).collect())) == sorted(want)
    assert glyphs.text_lines(df.limit(0), ["page"]).count() == 0


def test_table_text(spark):
    runs = [(1, 10.0, 700.0, "Name"), (1, 100.0, 700.0, "Due"), (1, 10.0, 680.0, "A|B"), (1, 300.0, 680.0, "5"), (1, 320.0, 680.2, "6")]
    out = glyphs.table_text(spark.createDataFrame(runs, "page long, x double, y double, text string"), ["page"]).collect()
    assert [(r.n_rows, r.markdown) for r in out] == [(2, "| Name | Due |  |\n|---|---|---|\n| A\\|B |  | 6 5 |")] or out[0].markdown == "| Name | Due |  |\n|---|---|---|\n| A\\|B |  | 5 6 |"


def test_bytes(spark):
    cases = [(b"plain", "plain"), (b"\xfe\xff\x00a\x00b\x00", "ab"), (b"\x00a\x00b\x00c", "abc"), ("é".encode(), "é"), (b"\x93caf\xe9\x94 \x80\x81", "“café” €\x81"), (b"", ""), (None, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, (b, _) in enumerate(cases)], "i int, b binary")
    assert [r.x for r in df.orderBy("i").select(M.decoded_bytes(F.col("b")).alias("x")).collect()] == [w for _, w in cases]


def test_columns(spark):
    assert one(spark, M.plain(F.col("t")), t="a<b>c&amp;lt;&#233;&#xD800;&nope;<x") == "ac&lt;é&#xD800;&nope;"
    assert one(spark, M.unlinked(F.col("t")), t="[a](b) `[c](d)` ![e](f) <br/> 1 < 2") == "a `[c](d)` e  1 < 2"
    assert [one(spark, M.roman_strict(F.col("t")), t=t) for t in ("xiv", "IIII", "Xi", "MCMXC", "", "mmmm", "ic")] == [14, None, None, 1990, None, 4000, None]
    assert [one(spark, M.condition_holds(F.col("c"), F.col("v")), c=c, v=5.0) for c in ("value()>=5", "value() < -1e1", "value()=x", "value()<>5.")] == [True, False, None, False]
    assert one(spark, glyphs.lower_median(F.col("g")), g=[4.0, 1.0, 3.0, 2.0]) == 2.0
    assert one(spark, M.height_bucket(F.col("y")), y=-0.25) == -3


def test_formats_that_are_none():
    assert [numberformats.loss(0, c, None) for c in ('0;0;0;"t"', "[bad]0", "0;;;", "@;0")] == [(True, False), (False, False), (True, False), (False, False)]
    assert numberformats.loss(0, "yyyy[bad]", 4.0) == (False, True) and numberformats.loss(0, "[color 57]0", 4.0) == (False, False)
    assert numberformats.loss(0, "# ?/16;[Red]# ?/16", -0.01) == (False, False) and numberformats.loss(0, "# ?/16;[Red]# ?/16", -0.1) == (False, True)


def test_depth_weighs_readings():
    path = ["a", None, None, None, None, None, None]
    assert [statutes.depth(t, path, False, False) for t in ("b", "1", "A", "i", "aa", "Ab")] == [0, 1, 2, 3, None if statutes.depth("aa", path, False, False) is None else 5, None]
