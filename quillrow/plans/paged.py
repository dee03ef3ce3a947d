"""Queries on decisions about pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.operators import pages
from quillrow.plans import inputs as I


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of text: a page for each user, directions and heights from ids and values."""
    e = I.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("page"), "event_id", (F.col("event_id") % 3 - 1).cast("double").alias("dx"), ((F.col("event_id") * 7) % 5 - 1).cast("double").alias("dy"), ((F.col("event_id") * 37) % 200).cast("double").alias("y"))


_RUNS = "r AS (SELECT user_id AS page, event_id, CAST(event_id % 3 - 1 AS DOUBLE) AS dx, CAST((event_id * 7) % 5 - 1 AS DOUBLE) AS dy, CAST((event_id * 37) % 200 AS DOUBLE) AS y FROM events)"


def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.turns(_runs(spark, sf_dir), ["page"])


TURNS_SQL = f"""WITH {_RUNS}, c AS (SELECT page, abs(dy) <= abs(dx) * 0.364 AS x, abs(dx) <= abs(dy) * 0.364 AS z, dy FROM r),
n AS (SELECT page, count(*) FILTER (x) AS a, count(*) FILTER (NOT x AND z AND dy > 0) AS u, count(*) FILTER (NOT x AND z AND dy <= 0) AS d FROM c GROUP BY 1)
SELECT page, CASE WHEN a + u + d < 2 OR (u + d) * 3 < (a + u + d) * 2 OR u = d THEN 'none' WHEN u > d THEN 'up' ELSE 'down' END AS turn FROM n"""


def page_jumbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.jumbled(_runs(spark, sf_dir), ["page"], "event_id")


JUMBLED_SQL = f"""WITH {_RUNS}, m AS (SELECT page, y - lag(y) OVER (PARTITION BY page ORDER BY event_id) AS m FROM r),
n AS (SELECT page, count(*) AS n, count(*) FILTER (m > 50) AS u, count(*) FILTER (m < -50) AS d FROM m GROUP BY 1)
SELECT page, n >= 5 AND u + d >= 3 AND u / greatest(u + d, 1) > 0.4 AS jumbled FROM n"""


def neighbouring_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.neighbours(I.statements(spark, sf_dir))


NEIGHBOURS_SQL = f"""WITH {I.STATEMENTS_SQL}, {I.LINES_SQL},
c AS (SELECT doc_id, list_filter(list_transform(string_split(raw, '|'), lambda c: regexp_replace(c, '[\\s|*_`#\\[\\]]', '', 'g')), lambda c: c <> '') AS l FROM lines WHERE starts_with(trim(raw), '|') AND ends_with(trim(raw), '|') AND length(trim(raw)) > 1 AND NOT regexp_matches(trim(raw), '^[|:\\- ]*$'))
SELECT DISTINCT doc_id, l[i] AS one, l[i + 1] AS other FROM c, unnest(range(1, len(l))) t(i)"""


def pages_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: pages from the third on, without those for OCR and, for some, only wanted ones."""
    o = I.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, 3).alias("first"), (F.col("o_orderkey") % 9).cast("int").alias("n"), F.array(F.lit(4), F.lit(6)).alias("ocr"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(3), F.lit(4), F.lit(5))).alias("wanted"))
    return o.select("o_orderkey", F.array_join(pages.unchecked(F.col("first"), F.col("n"), F.col("ocr"), F.col("wanted")).cast("array<string>"), ",").alias("pages"))


UNCHECKED_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN array_to_string(list_filter(range(3, o_orderkey % 9 + 1), lambda p: p NOT IN (4, 6) AND (o_orderkey % 2 = 1 OR p IN (3, 4, 5))), ',') END AS pages FROM orders"


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents, some empty, some garbled, some analysed."""
    d = I.table(spark, sf_dir, "documents")
    reason = F.when(F.col("doc_id") % 5 == 0, pages.GARBLED).otherwise("scanned")
    rows = d.select("doc_id", F.lit("TextBased").alias("pdf_type"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("markdown"), F.lit(0.9).alias("confidence"), F.lit("complex").alias("layout"), F.lit(False).alias("has_encoding_issues"), F.array(F.struct(F.lit(1).alias("page"), F.array(reason).alias("reasons"))).alias("ocr_reasons"), (F.col("doc_id") % 2 == 0).alias("analyzed"), (F.col("doc_id") % 4 > 0).alias("whole"))
    return pages.record(rows).select("doc_id", "confidence", "layout", "has_encoding_issues")


RECORDS_SQL = "SELECT doc_id, CAST(CASE WHEN doc_id % 4 > 0 AND (doc_id % 3 = 0 OR trim(text) = '') THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'complex' END AS layout, doc_id % 5 = 0 AS has_encoding_issues FROM documents"

CASES = [(1, True, None, None, None, True), (2, False, ["a"], ["b"], [], False), (3, True, ["shown"], ["x"], [], True), (4, True, ["q"], ["shown"], [], False), (5, True, ["q"], [], [], True), (6, False, ["q"], ["x"], ["shown"], True), (7, True, ["q"], ["shown", "lost"], [], True)]


def composite_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([c[:5] for c in CASES], "page int, misread boolean, read_as array<string>, says array<string>, evidence array<string>")
    shown = F.array(F.lit("shown"))
    return rows.select("page", pages.composite_misread(F.col("misread"), F.col("read_as"), F.col("says"), F.col("evidence"), shown).alias("reported"))


COMPOSITE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({c[0]}, {c[5]})" for c in CASES) + ") t(page, reported)"


def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word in whole documents, put before each text whole, split by a space, by a cell's edge, after a hyphen and over lines."""
    forms = ["re-covery", "re-cov ery", "re- covery", "re-cov|ery", "re-cov\nery"]
    made = F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x "), made, F.lit(" y\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return pages.split_words(docs, ["re-covery"])


SPLIT_SQL = "SELECT doc_id, 're-covery' AS word, CAST(1 AS BIGINT) AS splits, CAST(CASE WHEN doc_id % 5 = 2 THEN 0 ELSE 1 END AS BIGINT) AS definite FROM documents WHERE doc_id % 5 IN (1, 2, 3)"

QUERIES = {"page_turns": page_turns, "page_jumbled": page_jumbled, "neighbouring_cells": neighbouring_cells, "pages_unchecked": pages_unchecked, "document_records": document_records, "composite_fonts": composite_fonts, "split_words": split_words}

ORACLE_SQL = {"page_turns": TURNS_SQL, "page_jumbled": JUMBLED_SQL, "neighbouring_cells": NEIGHBOURS_SQL, "pages_unchecked": UNCHECKED_SQL, "document_records": RECORDS_SQL, "composite_fonts": COMPOSITE_SQL, "split_words": SPLIT_SQL}
