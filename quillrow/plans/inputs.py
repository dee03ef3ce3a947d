"""Inputs of the queries: the driver's tables, with Markdown put before or built from their rows.

The same expression is given for Spark and for SQL, so both engines read the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Openings by doc_id modulo 12; a text without one stays as it is.
FORM_HEADS = ["Form W-2", "## 1099-INT Transcript", "Form 1099 Composite", "Schedule K-1 (Form 1065)", "Schedule C (Form 1040) Profit or Loss From Business", "Form 1040", "Interest Income", "Form 1120-S", "U.S. Corporation Income Tax Return", "Wage and Tax Statement", "Nonemployee Compensation"]
FILING_HEADS = ["## Item 1.    Business", "PART I", "**Item 7A. Market Risk**", "|Item 1.|Business|3|"]
STATUTE_HEADS = ["## SUBTITLE A\n# CHAPTER 1\n## §1398. Rules for estates\n**(a) General rule**\n(1) First case\n(A) lower part", "**§1399. No separate entity**\n(a) In general\n(2) of section 3121(d)\n## Editorial Notes\nkept apart", "§1400. Repealed. Pub. L. 1\n(i) clause"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """A SQL string, with line feeds as chr(10)."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def headed(docs: DataFrame, heads: list[str], every: int = 12) -> DataFrame:
    """doc_id and text, with the opening of its remainder before it and another in its middle line."""
    out = F.col("text")
    for i, h in enumerate(heads):
        out = F.when(F.col("doc_id") % every == i, F.concat(F.lit(h + "\n"), "text")).otherwise(out)
    return docs.select("doc_id", out.alias("text"))


def headed_sql(heads: list[str], every: int = 12) -> str:
    cases = " ".join(f"WHEN {i} THEN {quoted(h + chr(10))} || text" for i, h in enumerate(heads))
    return f"SELECT doc_id, CASE doc_id % {every} {cases} ELSE text END AS text FROM documents"


#: Lines of a text in SQL: doc_id, ln, raw, off; from a relation named docs.
LINES_SQL = """
parts AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS p FROM docs WHERE text IS NOT NULL),
each AS (SELECT doc_id, i - 1 AS ln, p[i] AS raw FROM parts, unnest(range(1, len(p) + 1)) AS t(i)),
lines AS (SELECT doc_id, ln, raw, CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM each)
"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown statements of customers (doc_id, text), one table row per order, from orders."""
    orders = table(spark, sf_dir, "orders")
    price = F.format_string("%s.%s", F.floor("o_totalprice").cast("long").cast("string"), F.lpad(F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(100)).cast("string"), 2, "0"))
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), price, F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), price)).otherwise(""), F.lit(" | "), "o_orderstatus", F.lit(" |"))
    rows = orders.select("o_custkey", "o_orderkey", row.alias("row"), price.alias("price"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]), "\n")
    lead = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Order Amount Status "), F.regexp_replace(F.array_join(F.filter(F.split(F.split("body", "\n")[0], r"\|"), lambda c: F.trim(c) != ""), ""), r"\s+", " "), F.lit("\n\n"))).otherwise("Statement\n\n")
    tail = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("\n\nTotal 1,234.50 and "), "least")).otherwise("\n\nEnd")
    made = rows.groupBy("o_custkey").agg(body.alias("body"), F.min_by("price", "o_orderkey").alias("least"))
    return made.select(F.col("o_custkey").alias("doc_id"), F.concat(lead, F.lit("| Order | Amount | Status |\n|---|---|---|\n"), "body", tail).alias("text"))


STATEMENTS_SQL = """
priced AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS price FROM orders),
rowed AS (SELECT o_custkey, o_orderkey, price, '| ' || o_orderkey || ' | ' || price || CASE WHEN o_orderkey % 5 = 0 THEN ' ' || price ELSE '' END || ' | ' || o_orderstatus || ' |' AS row_text FROM priced),
made AS (SELECT o_custkey, string_agg(row_text, chr(10) ORDER BY o_orderkey) AS body, arg_min(price, o_orderkey) AS least FROM rowed GROUP BY o_custkey),
docs AS (SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN 'Order Amount Status ' || regexp_replace(array_to_string(list_filter(string_split(string_split(body, chr(10))[1], '|'), lambda c: trim(c) <> ''), ''), '\\s+', ' ', 'g') || chr(10) || chr(10) ELSE 'Statement' || chr(10) || chr(10) END
  || '| Order | Amount | Status |' || chr(10) || '|---|---|---|' || chr(10) || body || CASE WHEN o_custkey % 4 = 0 THEN chr(10) || chr(10) || 'Total 1,234.50 and ' || least ELSE chr(10) || chr(10) || 'End' END AS text FROM made)
"""
