"""Queries on lines, pipe tables, repeats and what a text shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.functions import text as T
from quillrow.operators import doubled, running, shown, tables
from quillrow.plans import inputs as I

_AMOUNT = T.AMOUNT.replace("'", "''")
_BLOCKS = f"""WITH {I.STATEMENTS_SQL}, {I.LINES_SQL},
m AS (SELECT *, starts_with(trim(raw), '|') AND ends_with(trim(raw), '|') AND length(trim(raw)) > 1 AS is_row, trim(raw) = '' AS blank FROM lines),
g AS (SELECT *, CASE WHEN coalesce(lag(is_row) OVER w <> is_row, true) OR coalesce(lag(blank) OVER w <> blank, true) THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
b AS (SELECT *, is_row AND regexp_matches(trim(raw), '^[|:\\- ]+$') AND contains(raw, '-') AS is_rule, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM g),
r AS (SELECT doc_id, block, ln, raw, row_number() OVER (PARTITION BY doc_id, block ORDER BY ln) - 1 AS row, list_transform(string_split(trim(raw)[2:-2], '|'), lambda c: trim(c)) AS cs FROM b WHERE is_row AND NOT is_rule),
c AS (SELECT doc_id, block, row, i - 1 AS col, cs[i] AS cell FROM r, unnest(range(1, len(cs) + 1)) AS t(i)),
a AS (SELECT *, CASE WHEN cell <> '' AND len(list_filter(string_split_regex(cell, '\\s+'), lambda t: NOT regexp_matches(t, '{_AMOUNT}'))) = 0 THEN len(string_split_regex(cell, '\\s+')) ELSE 0 END AS n_amounts FROM c),
paragraphs AS (SELECT doc_id, block, string_agg(raw, ' ' ORDER BY ln) AS paragraph FROM b WHERE NOT is_row AND NOT blank GROUP BY 1, 2)"""


def md_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of customers' statements."""
    return tables.cells(I.statements(spark, sf_dir))


def md_amount_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by column of the statements."""
    return tables.cells(I.statements(spark, sf_dir)).groupBy("col").agg(F.sum("n_amounts").alias("n_amounts"), F.count_if(F.col("n_amounts") > 1).alias("n_merged"))


def md_merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merged(I.statements(spark, sf_dir))


def md_rows_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rows_repeated(I.statements(spark, sf_dir))


def md_detached_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.detached(I.statements(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of one source as one paged document: its pages' lines with heights, and the Markdown."""
    docs = I.table(spark, sf_dir, "documents")
    # Pages are numbered on narrow rows, so that no source's texts are sorted.
    place = docs.select("source", "doc_id").withColumn("page", F.dense_rank().over(I.W.partitionBy("source").orderBy("doc_id")).cast("long")).distinct()
    own = docs.select("doc_id", "text").join(place, "doc_id").select("source", "doc_id", "page", F.concat(F.lit("Quarterly report of "), "source", F.lit("\n"), "text", F.lit("\nprinted on page "), F.col("page").cast("string")).alias("text"))
    lines = T.lines(own).join(place, "doc_id").select("source", "page", (F.lit(800.0) - F.col("ln") * 10).alias("y"), F.col("raw").alias("text"))
    text = docs.where(F.length("source") == 4).select(F.col("source"), F.concat(F.lit("1 Quarterly report of "), "source").alias("text")).distinct()
    return lines, text


def running_header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a source's pages repeat near their edges."""
    return running.repeated(_pages(spark, sf_dir)[0], "source")


def running_header_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such lines that the source's Markdown lacks."""
    lines, text = _pages(spark, sf_dir)
    return running.lost(lines, text, "source")


_RUNNING = f"""WITH own AS (SELECT source, doc_id, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents),
docs AS (SELECT doc_id, 'Quarterly report of ' || source || chr(10) || text || chr(10) || 'printed on page ' || page AS text FROM own), {I.LINES_SQL},
pl AS (SELECT source, page, 800.0::DOUBLE - ln * 10 AS y, raw AS text FROM lines JOIN own USING (doc_id)),
e AS (SELECT *, dense_rank() OVER (PARTITION BY source, page ORDER BY y DESC) AS a, dense_rank() OVER (PARTITION BY source, page ORDER BY y) AS z FROM pl),
k AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\p{{N}}+', '')), '\\p{{N}}+$', '')) AS line_key FROM e WHERE (a <= 5 OR z <= 5) AND NOT regexp_matches(trim(text), '^(#{{1,6}}\\s|[-*+•]\\s|[0-9]{{1,3}}[.)]\\s)') AND len(list_distinct(string_split(trim(text), ''))) > 1),
hs AS (SELECT source, page, max(y) - min(y) AS height FROM pl GROUP BY 1, 2),
s AS (SELECT source, count(*) AS page_count, greatest(avg(height), 1.0) AS span FROM hs GROUP BY 1),
o AS (SELECT source, line_key, count(DISTINCT page) AS pages, stddev_pop(y) AS spread, min(page) AS first_page, arg_min(text, (page, text)) AS first_text FROM k WHERE length(line_key) >= 10 GROUP BY 1, 2),
f AS (SELECT source, line_key, pages, first_page, first_text FROM o JOIN s USING (source) WHERE pages >= greatest(3, floor(page_count * 0.3)) AND spread / span < 0.05)"""


def doubled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 1 to 64 words that documents say twice at once."""
    return doubled.repeated(I.table(spark, sf_dir, "documents"))


def doubled_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with every character doubled, of whole texts; one is put into each seventh document."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("TToottaall "), "text")).otherwise(F.col("text")).alias("text"))
    return doubled.glyphs(docs)


def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document shows."""
    return shown.shown(I.table(spark, sf_dir, "documents"), I.table(spark, sf_dir, "benchmark"))


def unshown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of the next document that a document doesn't show."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.substring("text", 1, 12).alias("value"))
    return shown.unshown(asked, docs)


_BARE = "regexp_replace({}, '[\\s|*_`#\\[\\]]', '', 'g')"


def bare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare length and digest of every page's source."""
    b = T.bare(F.col("html"))
    return I.table(spark, sf_dir, "pages").select("page_id", F.length(b).cast("long").alias("n"), F.md5(b).alias("digest"))


QUERIES = {
    "md_table_cells": md_table_cells,
    "md_amount_counts": md_amount_counts,
    "md_merged_cells": md_merged_cells,
    "md_rows_repeated": md_rows_repeated,
    "md_detached_amounts": md_detached_amounts,
    "running_header_candidates": running_header_candidates,
    "running_header_lost": running_header_lost,
    "doubled_words": doubled_words,
    "doubled_glyphs": doubled_glyphs,
    "shown_texts": shown_texts,
    "unshown_texts": unshown_texts,
    "bare_text": bare_text,
}

ORACLE_SQL = {
    "md_table_cells": f"{_BLOCKS} SELECT doc_id, block, row, col, cell, CAST(n_amounts AS BIGINT) AS n_amounts FROM a",
    "md_amount_counts": f"{_BLOCKS} SELECT col, CAST(sum(n_amounts) AS BIGINT) AS n_amounts, count(*) FILTER (n_amounts > 1) AS n_merged FROM a GROUP BY 1",
    "md_merged_cells": f"{_BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, row, col) AS k FROM a WHERE n_amounts >= 2) SELECT doc_id, block, row, col, cell, CAST(n_amounts AS BIGINT) AS n_amounts FROM n WHERE k <= 256",
    "md_rows_repeated": f"{_BLOCKS}, said AS (SELECT doc_id, block, string_agg(regexp_replace(array_to_string(list_filter(cs, lambda c: c <> ''), ' '), '\\s+', ' ', 'g'), ' ' ORDER BY row) AS s, count(*) AS n FROM r WHERE row < 2 GROUP BY 1, 2) SELECT DISTINCT s.doc_id, s.block FROM said s JOIN paragraphs p ON s.doc_id = p.doc_id AND s.block - p.block IN (1, 2) WHERE n = 2 AND (trim(regexp_replace(paragraph, '\\s+', ' ', 'g')) = s OR ends_with(trim(regexp_replace(paragraph, '\\s+', ' ', 'g')), ' ' || s))",
    "md_detached_amounts": f"{_BLOCKS}, held AS (SELECT doc_id, block, flatten(list(string_split_regex(cell, '\\s+'))) AS h FROM c GROUP BY 1, 2), after_ AS (SELECT p.doc_id, h.block, list_filter(string_split_regex(paragraph, '\\s+'), lambda t: regexp_matches(t, '{_AMOUNT}')) AS x, h FROM paragraphs p JOIN held h ON p.doc_id = h.doc_id AND p.block - h.block IN (1, 2)), o AS (SELECT doc_id, block, list_filter(x, lambda t: NOT list_contains(h, t)) AS l FROM after_) SELECT doc_id, block, array_to_string(l, ' ') AS amounts FROM o WHERE len(l) > 0",
    "running_header_candidates": f"{_RUNNING} SELECT * FROM f",
    "doubled_glyphs": """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'TToottaall ' || text ELSE text END AS text FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(x, '[*_`|#]', '', 'g')), lambda x: x <> '') AS w FROM d),
e AS (SELECT doc_id, i - 1 AS pos, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS t(i)),
p AS (SELECT *, array_to_string(list_transform(range(1, length(word), 2), lambda k: word[k]), '') AS painted_once, array_to_string(list_transform(range(2, length(word) + 1, 2), lambda k: word[k]), '') AS again FROM e WHERE length(word) >= 4 AND length(word) % 2 = 0)
SELECT doc_id, pos, word, painted_once FROM p WHERE painted_once = again AND replace(word, word[1], '') <> ''""",
    "shown_texts": f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains({_BARE.format('d.text')}, {_BARE.format('b.text')})",
    "unshown_texts": f"WITH q AS (SELECT doc_id + 1 AS doc_id, substr(text, 1, 12) AS value FROM documents) SELECT q.doc_id, value FROM q LEFT JOIN documents d USING (doc_id) WHERE NOT contains(coalesce({_BARE.format('d.text')}, ''), {_BARE.format('value')})",
    "bare_text": f"SELECT page_id, length({_BARE.format('html')}) AS n, md5({_BARE.format('html')}) AS digest FROM pages",
}
#: Only sources of four characters keep their header in the Markdown.
ORACLE_SQL["running_header_lost"] = f"{_RUNNING} SELECT * FROM f WHERE NOT (length(source) = 4 AND line_key = trim(regexp_replace('Quarterly report of ' || source, '\\p{{N}}+$', '')))"
