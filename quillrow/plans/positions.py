"""Queries on marked-up text, glyph gaps and places, tables by position, and masked running headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.functions import markup as M
from quillrow.functions import text as T
from quillrow.operators import glyphs, running, tables
from quillrow.plans import inputs as I


def text_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the digest of its first 1,024 characters, whether it names a currency, and its pieces."""
    docs = I.table(spark, sf_dir, "documents")
    pieces = M.line_pieces(F.col("text"))
    return docs.select("doc_id", F.md5(M.truncated(F.col("text"), 1024)).alias("opening"), M.has_currency(F.col("text")).alias("currency"), F.size(pieces).cast("long").alias("n_pieces"), F.md5(F.array_join(pieces, "\n")).alias("pieces"))


TRAITS_SQL = """
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+|\\p{L}+|[^0-9\\p{L}]+') AS p FROM documents)
SELECT doc_id, md5(substr(text, 1, 1024)) AS opening, regexp_matches(text, '[$€£¥]') AS currency, len(p) AS n_pieces, md5(array_to_string(p, chr(10))) AS pieces FROM d"""


def roman_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, and the numbers of their ids written out, that are Roman numerals: value and occurrences."""
    docs = I.table(spark, sf_dir, "documents").select(F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, ["xiv", "MCMXC", "iiii", "Xi", "mmmmcdxliv"])), (F.col("doc_id") % 5 + 1).cast("int"))).alias("text"))
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("value", M.roman_strict(F.col("word"))).where("value IS NOT NULL").select("word", "value", "n")


# Numerals are spelled out from their values, so the spelling is checked the other way round.
ROMAN_SQL = """
WITH d AS (SELECT concat_ws(' ', text, ['xiv', 'MCMXC', 'iiii', 'Xi', 'mmmmcdxliv'][doc_id % 5 + 1]) AS text FROM documents),
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM d) GROUP BY 1),
v AS (SELECT i AS value, repeat('m', CAST(i // 1000 AS INTEGER)) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][i // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][i // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][i % 10 + 1] AS spelled FROM range(1, 13000) t(i))
SELECT word, value, n FROM w JOIN (SELECT value, spelled FROM v UNION ALL SELECT value, upper(spelled) FROM v) v ON spelled = word WHERE length(word) <= 12"""


def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without tags and with its characters decoded, and its links' texts."""
    pages = I.table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit(" caf&#233;&#x21; &amp;lt; &bogus; [a](http://b) `[c](d)` <i>e</i>")).alias("t"))
    plain, bare = M.plain(F.col("t")), M.unlinked(F.col("t"))
    return pages.select("page_id", F.length(plain).cast("long").alias("n"), F.md5(plain).alias("plain"), F.md5(bare).alias("unlinked"))


PLAIN_SQL = """
WITH p AS (SELECT page_id, html || ' caf&#233;&#x21; &amp;lt; &bogus; [a](http://b) `[c](d)` <i>e</i>' AS t FROM pages),
s AS (SELECT page_id, t, regexp_extract_all(regexp_replace(t, '<[^>]*(?:>|$)', '', 'g'), '&(?:amp|lt|gt|quot|apos|nbsp|#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9});|[^&]+|&') AS s FROM p),
e AS (SELECT page_id, t, array_to_string(list_transform(s, lambda x: CASE x WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN '''' WHEN '&nbsp;' THEN chr(160) WHEN '&#233;' THEN 'é' WHEN '&#x21;' THEN '!' ELSE x END), '') AS plain FROM s)
SELECT page_id, length(plain) AS n, md5(plain) AS plain, md5(regexp_replace(t, '(`[^`]*`)|!?\\[([^\\]]*)\\]\\([^)]*\\)|</?[A-Za-z][^>]*>', '\\1\\2', 'g')) AS unlinked FROM e"""


def order_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a condition on their price and the bucket of their height."""
    conditions = ["value()>=150000", "value() < 100000.5", "value()!=1", "value()<>2", "value()=3", "cell()>1"]
    orders = I.table(spark, sf_dir, "orders")
    picked = F.element_at(F.array(*map(F.lit, conditions)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return orders.select("o_orderkey", M.condition_holds(picked, F.col("o_totalprice")).alias("holds"), M.height_bucket(F.round("o_totalprice", 1) / 100).alias("bucket"))


CONDITIONS_SQL = """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice >= 150000 WHEN 1 THEN o_totalprice < 100000.5 WHEN 2 THEN o_totalprice <> 1 WHEN 3 THEN o_totalprice <> 2 WHEN 4 THEN o_totalprice = 3 END AS holds,
CAST(round(round(o_totalprice, 1) / 100 * 10) AS INTEGER) AS bucket FROM orders"""


def word_gap_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document how many of its words' gaps are spaces; some words are put into other scripts."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat(F.lit("漢 字 שלום a , b ”c d% ) e "), "text"), r"\s+").alias("w"))
    pairs = docs.select("doc_id", F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> struct(right(w[i], 1) AS a, left(w[i + 1], 1) AS b))")).alias("p"))
    taken = glyphs.takes_space(F.col("p.a"), F.col("p.b"))
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(taken).alias("n_spaces"))


_CLASS = glyphs.SPACELESS[1:-1] + glyphs.RIGHT_TO_LEFT[1:-1]
SPACES_SQL = f"""
WITH d AS (SELECT doc_id, string_split_regex('漢 字 שלום a , b ”c d% ) e ' || text, '\\s+') AS w FROM documents),
p AS (SELECT doc_id, right(w[i], 1) AS a, left(w[i + 1], 1) AS b FROM d, unnest(range(1, len(w))) AS t(i))
SELECT doc_id, count(*) AS n, count(*) FILTER (a <> '' AND b <> '' AND NOT regexp_matches(a, '[{_CLASS}]') AND NOT regexp_matches(b, '[{_CLASS}]') AND NOT contains('.,;:!?)]}}%’”»', b)) AS n_spaces FROM p GROUP BY 1"""


def tracking_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter spacing that the gaps of each user's events show, and their lower median."""
    e = I.table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.collect_list("value").alias("g"))
    own = e.withColumn("t", glyphs.tracking(F.col("g"), F.lit(40.0)))
    return own.select("user_id", glyphs.lower_median(F.col("g")).alias("middle"), F.col("t.gap").alias("gap"), F.col("t.capitals").alias("capitals"))


TRACKING_SQL = """
WITH e AS (SELECT user_id, list_sort(list(value)) AS g FROM events WHERE value IS NOT NULL GROUP BY 1),
m AS (SELECT user_id, g, g[(len(g) - 1) // 2 + 1] AS middle FROM e),
n AS (SELECT user_id, middle, list_filter(g, lambda x: x <= middle + 40.0) AS near FROM m),
t AS (SELECT user_id, middle, near[(len(near) - 1) // 2 + 1] AS gap FROM n)
SELECT user_id, middle, CASE WHEN gap >= 20.0 AND gap <= 120.0 THEN gap END AS gap, CASE WHEN gap >= 20.0 AND gap <= 120.0 THEN gap >= 50.0 END AS capitals FROM t"""


def placed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as points under two transforms."""
    lines = I.table(spark, sf_dir, "lineitem")
    m = F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.5), F.col("l_linenumber").cast("double"), F.lit(4.0))
    n = F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(8.0), F.col("l_quantity"))
    at = glyphs.placed(glyphs.composed(m, n), F.col("l_quantity"), F.col("l_tax"))
    return lines.groupBy("l_orderkey").agg(F.max(at["x"]).alias("x"), F.max(at["y"]).alias("y"))


PLACED_SQL = "SELECT l_orderkey, max(-1.0 * (0.5 * l_tax + 4.0) + 8.0) AS x, max(2.0 * l_quantity + l_linenumber + l_quantity) AS y FROM lineitem GROUP BY 1"


def column_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part sold above each line of an order, in columns of quantity."""
    lines = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("x"))
    own = lines.select("l_orderkey", F.col("l_linenumber").alias("glyph"), "x", (F.lit(100.0) - F.col("l_linenumber") * 7).alias("y"))
    return glyphs.earlier_in_column(own, ["l_orderkey"], 10.0).select("l_orderkey", "glyph", "above", "drop")


NEIGHBOURS_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber AS glyph, max(l_quantity) AS x, 100.0 - l_linenumber * 7 AS y FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, glyph, lag(glyph) OVER w AS above, CAST(lag(y) OVER w - y AS DOUBLE) AS drop FROM l WINDOW w AS (PARTITION BY l_orderkey, floor(x / 10.0) ORDER BY y DESC, x, glyph)"""


def lines_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of orders' lines as runs on a page."""
    return glyphs.text_lines(_runs(spark, sf_dir), ["page"])


def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of orders' lines as runs on a page."""
    return glyphs.table_text(_runs(spark, sf_dir), ["page"], 60.0)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 8).alias("x"), (F.lit(700.0) - F.col("l_linenumber") * 2 - F.col("l_discount") * 10).alias("y"), F.col("l_partkey").cast("string").alias("text"))


def lines_not_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each customer's page that aren't rows of its statement: an order's own row, one cell, or a line of its own."""
    orders = I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"))
    held = orders.select("doc_id", F.concat(F.lit("| "), "k", F.lit(" | *"), "s", F.lit("* |")).alias("row"))
    items = F.when(F.col("o_orderkey") % 3 == 0, F.array("k", "s")).when(F.col("o_orderkey") % 3 == 1, F.array("s", F.lit(""), "k")).otherwise(F.array("k", F.lit("paid")))
    return tables.not_rows(orders.select("doc_id", "o_orderkey", items.alias("items")), held, ["doc_id"]).select("doc_id", "o_orderkey")


NOT_ROWS_SQL = "SELECT o_custkey AS doc_id, o_orderkey FROM orders WHERE o_orderkey % 3 = 2"


def detached_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which most amounts stand beside a label."""
    lines = I.table(spark, sf_dir, "lineitem")
    amounts = lines.select("l_orderkey", F.col("l_quantity").alias("y"))
    labels = lines.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_quantity") + F.col("l_linenumber") - 3).alias("y"))
    return tables.on_label_lines(amounts, labels, ["l_orderkey"], 4.0)


MAJORITY_SQL = """
WITH a AS (SELECT row_number() OVER () AS i, l_orderkey, l_quantity AS y FROM lineitem), l AS (SELECT l_orderkey, l_quantity + l_linenumber - 3 AS y FROM lineitem WHERE l_returnflag = 'R'),
h AS (SELECT DISTINCT a.i, a.l_orderkey FROM a JOIN l ON a.l_orderkey = l.l_orderkey AND abs(a.y - l.y) <= 4.0),
n AS (SELECT l_orderkey, count(*) AS n_read FROM a GROUP BY 1), m AS (SELECT l_orderkey, count(*) AS n_on_rows FROM h GROUP BY 1)
SELECT l_orderkey, n_read, n_on_rows FROM n JOIN m USING (l_orderkey) WHERE 2 * n_on_rows > n_read"""


def resolved_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of orders' lines as cells: their own, their row's, or their span's of columns."""
    lines = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    cells = lines.select(F.col("l_orderkey").alias("sheet"), (F.col("part") % 4).alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.when(F.col("part") % 3 == 0, F.concat(F.lit("c"), F.col("part").cast("string"))).alias("style"))
    rows = cells.where("row < 2").select("sheet", "row", F.concat(F.lit("r"), F.col("row").cast("string")).alias("row_style")).distinct()
    spans = cells.select("sheet").distinct().select("sheet", F.lit(2).cast("long").alias("start"), (F.col("sheet") % 4 + 3).alias("end"), F.lit("span").alias("span_style"))
    return tables.cell_styles(cells, rows, spans).groupBy("applies").agg(F.count("*").alias("n"))


STYLES_SQL = """
WITH l AS (SELECT l_orderkey AS sheet, l_linenumber AS col, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
s AS (SELECT CASE WHEN part % 3 = 0 THEN 'c' || part WHEN part % 4 < 2 THEN 'r' || part % 4 WHEN col >= 2 AND col < sheet % 4 + 3 THEN 'span' END AS applies FROM l)
SELECT applies, count(*) AS n FROM s GROUP BY 1"""


def items_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each order's lines, one taken away for each line that was returned."""
    lines = I.table(spark, sf_dir, "lineitem")
    gone = lines.where("l_linenumber > 2 AND l_returnflag <> 'R'")
    left = tables.without_once(lines.select("l_orderkey", "l_returnflag"), gone)
    return left.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))


LEFT_SQL = "SELECT l_orderkey, l_returnflag, count(*) AS n FROM (SELECT l_orderkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber > 2 AND l_returnflag <> 'R') t GROUP BY 1, 2"


def running_header_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with page numbers inside that a source's pages repeat near their edges, pages being of unequal height.

    No page's number exceeds the total beside it: beyond 5,000 the total is the page itself, as a greater number doesn't count.
    """
    docs = I.table(spark, sf_dir, "documents")
    place = docs.select("source", "doc_id").withColumn("page", F.row_number().over(I.W.partitionBy("source").orderBy("doc_id")).cast("long"))
    n, total = F.col("page").cast("string"), F.greatest(F.col("page"), F.lit(5000)).cast("string")
    own = docs.select("doc_id", "text").join(place, "doc_id").select("source", "doc_id", "page", F.concat(F.lit("Report of "), "source", F.lit(" page "), n, F.lit(" of "), total, F.lit("\n"), "text", F.lit("\nPrinted at 10:32:07 on sheet "), n, F.lit("\nInvoice no. "), F.col("doc_id").cast("string"), F.lit(" kept")).alias("text"))
    lines = T.lines(own).join(place, "doc_id").select("source", "page", (F.lit(800.0) - F.col("ln") * 10).alias("y"), F.col("raw").alias("text"))
    return running.repeated(lines, "source", running.masked_key).where(F.col("line_key").contains("#"))


# The two headers as they are masked; their places are computed from all lines of all pages.
MASKED_SQL = """
WITH place AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents),
n AS (SELECT source, page, text, CASE WHEN text = '' OR text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS k FROM documents JOIN place USING (source, doc_id)),
h AS (SELECT source, page, CASE WHEN text = '' THEN 1 ELSE k END + 2 AS last FROM n WHERE text IS NOT NULL),
s AS (SELECT source, count(*) AS page_count, greatest(avg(10.0 * last), 1.0) AS span FROM h GROUP BY 1),
c AS (SELECT source, page, 800.0 AS y, 'Report of ' || source || ' page # of #' AS line_key, 'Report of ' || source || ' page ' || page || ' of 5000' AS text FROM h
  UNION ALL SELECT source, page, 800.0 - 10 * (last - 1), 'Printed at #:#:# on sheet #', 'Printed at 10:32:07 on sheet ' || page FROM h),
o AS (SELECT source, line_key, count(DISTINCT page) AS pages, stddev_pop(y) AS spread, min(page) AS first_page, arg_min(text, page) AS first_text FROM c GROUP BY 1, 2)
SELECT source, line_key, pages, first_page, first_text FROM o JOIN s USING (source) WHERE pages >= greatest(3, floor(page_count * 0.3)) AND spread / span < 0.05"""

QUERIES = {
    "text_traits": text_traits, "roman_words": roman_words, "plain_pages": plain_pages, "order_conditions": order_conditions, "word_gap_spaces": word_gap_spaces, "tracking_gaps": tracking_gaps, "placed_points": placed_points, "column_neighbours": column_neighbours,
    "lines_of_runs": lines_of_runs, "table_regions": table_regions, "lines_not_in_tables": lines_not_in_tables, "detached_majority": detached_majority, "resolved_styles": resolved_styles, "items_left": items_left, "running_header_masked": running_header_masked,
}

#: Lines are folds over their runs: tests hold them against a plain loop.
ORACLE_SQL = {
    "text_traits": TRAITS_SQL, "roman_words": ROMAN_SQL, "plain_pages": PLAIN_SQL, "order_conditions": CONDITIONS_SQL, "word_gap_spaces": SPACES_SQL, "tracking_gaps": TRACKING_SQL, "placed_points": PLACED_SQL, "column_neighbours": NEIGHBOURS_SQL,
    "lines_not_in_tables": NOT_ROWS_SQL, "detached_majority": MAJORITY_SQL, "resolved_styles": STYLES_SQL, "items_left": LEFT_SQL, "running_header_masked": MASKED_SQL,
}
