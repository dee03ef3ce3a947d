"""Queries on reviews, tax forms, filings and statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.functions import text as T
from quillrow.operators import filings, forms, review, statutes
from quillrow.plans import inputs as I
from quillrow.sources import packages


def _values(name: str) -> str:
    """A constant table as a SQL relation of the same name."""
    rows, schema = packages.COLUMNS[name]
    cols = [c.strip().split(" ")[0] for c in schema.split(",")]
    said = ", ".join("(" + ", ".join(I.quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {said}) AS t({', '.join(cols)}))"


def compare_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as returned against the sum of their lines, within 50,000."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("amount"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("reference"))
    lines = I.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("amount"), F.concat(F.count("*").cast("string"), F.lit(" lines")).alias("reference"))
    return review.compare_tables(orders, lines, "o_orderkey", 50_000)


COMPARE_SQL = """
WITH r AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS amount, 'order ' || o_orderkey AS reference FROM orders),
s AS (SELECT l_orderkey AS k, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS amount, count(*) || ' lines' AS reference FROM lineitem GROUP BY 1),
b AS (SELECT CAST(coalesce(r.k, s.k) AS VARCHAR) AS label, coalesce(r.amount, 0) AS return_amount, coalesce(s.amount, 0) AS source_amount, coalesce(r.reference, 'missing') AS return_reference, coalesce(s.reference, 'missing') AS source_reference, CAST(50000 AS BIGINT) AS tolerance FROM r FULL JOIN s ON r.k = s.k),
d AS (SELECT *, return_amount - source_amount AS difference, abs(return_amount - source_amount) AS absolute_difference FROM b)
SELECT *, CASE WHEN absolute_difference <= tolerance THEN 'pass' ELSE 'flag' END AS status,
 CASE WHEN absolute_difference <= tolerance THEN 'info' WHEN absolute_difference >= 1000 THEN 'critical' ELSE 'warning' END AS severity,
 CASE WHEN absolute_difference <= tolerance THEN label || ' ties within tolerance: return ' || return_amount || ' vs source ' || source_amount || '.'
 ELSE label || ' differs by ' || difference || ': return ' || return_amount || ' at ' || return_reference || ' vs source ' || source_amount || ' at ' || source_reference || '.' END AS message FROM d
"""

_COMPARED = f"""{_values("line_items")}, {_values("advisories")},
compared AS (SELECT *, return_amount - source_amount AS difference, abs(return_amount - source_amount) <= greatest(tolerance, 0) AS ties FROM line_items),
rows_ AS (SELECT package_id, 0 AS part, position, CASE WHEN abs(difference) >= 1000 THEN 'critical' ELSE 'warning' END AS severity, category, label || ' does not tie' AS title,
  label || ' differs by ' || difference || ': return ' || return_amount || ' at ' || return_reference || ' vs source ' || source_amount || ' at ' || source_reference || '.' AS detail, return_reference, source_reference, recommended_action, 0.92 AS confidence FROM compared WHERE NOT ties
 UNION ALL SELECT package_id, 1, position, severity, category, title, detail, return_reference, NULL, recommended_action, 0.74 FROM advisories),
found AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY part, position) AS number FROM rows_),
checks AS (SELECT package_id, ties AS passed, CASE WHEN ties THEN 'info' WHEN abs(difference) >= 1000 THEN 'critical' ELSE 'warning' END AS severity FROM compared UNION ALL SELECT package_id, false, severity FROM advisories),
sums AS (SELECT package_id, count(*) FILTER (NOT passed) AS total_findings, count(*) FILTER (NOT passed AND severity = 'critical') AS critical, count(*) FILTER (NOT passed AND severity = 'warning') AS warning, count(*) FILTER (NOT passed AND severity = 'info') AS info, count(*) FILTER (passed) AS checks_passed, count(*) AS checks_total FROM checks GROUP BY 1),
scored AS (SELECT *, least(CAST(CAST(CAST(checks_passed AS FLOAT) / CAST(checks_total AS FLOAT) AS FLOAT) * CAST(0.25 AS FLOAT) + CAST(0.72 AS FLOAT) AS FLOAT), CAST(0.97 AS FLOAT)) AS score FROM sums)"""

FINDINGS_SQL = f"WITH {_COMPARED} SELECT package_id, severity, category, title, detail, return_reference, source_reference, recommended_action, CAST(confidence AS DOUBLE) AS confidence, 'F-' || lpad(CAST(number AS VARCHAR), 3, '0') AS finding_id FROM found"
SUMMARY_SQL = f"WITH {_COMPARED} SELECT package_id, total_findings, critical, warning, info, checks_passed, checks_total, round(CAST(score AS DOUBLE), 6) AS confidence_score FROM scored"
LISTING_SQL = f"""WITH {_COMPARED}, {_values("packages")}, {_values("documents")},
d AS (SELECT package_id, count(*) FILTER (role = 'form') AS form_count, count(*) FILTER (role = 'source') AS source_doc_count FROM documents GROUP BY 1)
SELECT p.package_id, p.title, p.return_type, p.tax_year, form_count, source_doc_count, checks_total AS check_count, total_findings AS expected_findings FROM packages p LEFT JOIN d USING (package_id) LEFT JOIN sums USING (package_id)"""
_TAIL = "## Skipped Checks\n" + "".join(f"- {x}\n" for x in packages.SKIPPED_CHECKS) + "\n## Next Steps\n" + "".join(f"- {x}\n" for x in packages.NEXT_STEPS)
MEMO_SQL = f"""WITH {_COMPARED}, {_values("packages")},
n AS (SELECT chr(10) AS nl),
blocks AS (SELECT package_id, string_agg('### F-' || lpad(CAST(number AS VARCHAR), 3, '0') || ' - ' || upper(severity[1]) || severity[2:] || ': ' || title || nl || detail || nl || nl || '- Return: ' || return_reference || nl || coalesce('- Source: ' || source_reference || nl, '') || '- Action: ' || recommended_action || nl || nl, '' ORDER BY number) AS b FROM found, n GROUP BY 1)
SELECT p.package_id, '# Tax Review Memo - ' || title || ' (' || return_type || ', TY ' || tax_year || ')' || nl || nl || '## Summary' || nl || '- Findings: ' || total_findings || ' (' || critical || ' critical, ' || warning || ' warning, ' || info || ' info)' || nl || '- Checks passed: ' || checks_passed || ' of ' || checks_total || nl || '- Confidence score: ' || CAST(round_even(CAST(CAST(score * CAST(100 AS FLOAT) AS FLOAT) AS DOUBLE), 0) AS INTEGER) || '%' || nl || nl || '## Findings' || nl || coalesce(b, '- No findings above tolerance.' || nl) || {I.quoted(_TAIL)} AS memo
FROM packages p JOIN scored USING (package_id) LEFT JOIN blocks USING (package_id), n"""


def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered findings of the built-in packages."""
    return review.findings(packages.table(spark, "line_items"), packages.table(spark, "advisories")).drop("number")


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and score of the built-in packages."""
    out = review.summaries(packages.table(spark, "line_items"), packages.table(spark, "advisories"))
    return out.withColumn("confidence_score", F.round(F.col("confidence_score").cast("double"), 6))


def list_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.listing(spark)


def review_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.memos(spark)


def package_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked ids, one of them unknown."""
    asked = spark.createDataFrame([("demo_1099_bundle",), ("nothing",)], "package_id string")
    return review.looked_up(spark, asked).select("package_id", "title", "error")


LOOKUP_SQL = f"WITH {_values('packages')} SELECT a.package_id, title, CASE WHEN title IS NULL THEN 'unknown demo package' END AS error FROM (VALUES ('demo_1099_bundle'), ('nothing')) a(package_id) LEFT JOIN packages USING (package_id)"


def tax_form_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of every document."""
    return forms.identify(I.headed(I.table(spark, sf_dir, "documents"), I.FORM_HEADS))


def tax_form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tax_form_ladder(spark, sf_dir).groupBy("form_type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def _ladder_sql() -> str:
    form, confidence, match = [], [], []
    for p, f, c in forms.RULES:
        pattern = f"(?im){p}".replace("'", "''")
        hit = f"regexp_matches(o, '{pattern}')"
        form.append(f"WHEN {hit} THEN '{f}'")
        confidence.append(f"WHEN {hit} THEN {c}")
        match.append(f"WHEN {hit} THEN regexp_extract(o, '{pattern}')")
    return f"""WITH docs AS ({I.headed_sql(I.FORM_HEADS)}),
chars AS (SELECT doc_id, text, i, substr(text, i, 1) AS c FROM docs, unnest(range(1, least(length(text), 5000) + 1)) AS t(i) WHERE strlen(text) > 5000),
ended AS (SELECT doc_id, i, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM chars),
cut AS (SELECT doc_id, max(i) AS n FROM ended WHERE e <= 5000 GROUP BY 1),
opening AS (SELECT d.doc_id, CASE WHEN n IS NULL THEN text ELSE substr(text, 1, n) END AS o FROM docs d LEFT JOIN cut USING (doc_id)),
said AS (SELECT doc_id, o, CASE {' '.join(form)} ELSE 'unknown' END AS form_type, CAST(CASE {' '.join(confidence)} ELSE 0.0 END AS DOUBLE) AS confidence, CASE {' '.join(match)} ELSE '' END AS raw_match FROM opening)"""


def tax_prefix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each document's first 5,000 bytes are, in whole characters."""
    p = T.byte_prefix(F.col("text"), forms.OPENING)
    return I.table(spark, sf_dir, "documents").select("doc_id", F.octet_length(p).cast("long").alias("n_bytes"), F.length(p).cast("long").alias("n_chars"))


def doc_lines_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset of every line of every document."""
    return T.lines(I.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("ln").cast("long").alias("ln"), "off", F.octet_length("raw").cast("long").alias("n_bytes"))


def sec_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents that open like filings."""
    out = filings.sections(I.headed(I.table(spark, sf_dir, "documents"), I.FILING_HEADS))
    return out.withColumn("content", F.md5("content"))


SEC_SQL = f"""WITH docs AS ({I.headed_sql(I.FILING_HEADS)}), {I.LINES_SQL},
m AS (SELECT *, regexp_matches(raw, '(?i)^\\s*#{{0,4}}\\s*\\*{{0,2}}\\s*PART\\s+([IVX]+)\\s*\\*{{0,2}}\\s*$') AS p, regexp_matches(raw, '(?i)^\\s*#{{0,4}}\\s*\\*{{0,2}}\\s*ITEM\\s+(\\d+[A-Z]?)\\s*\\.?\\s*(.*)') AS i FROM lines),
s AS (SELECT *, sum(CASE WHEN p OR i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS section FROM m),
h AS (SELECT doc_id, section, off AS char_offset, CASE WHEN p THEN trim(raw) ELSE 'Item ' || regexp_extract(raw, '(?i)ITEM\\s+(\\d+[A-Z]?)', 1) || CASE WHEN trim(regexp_extract(raw, '(?i)ITEM\\s+\\d+[A-Z]?\\s*\\.?\\s*(.*)', 1)) = '' THEN '' ELSE ' - ' || trim(regexp_extract(raw, '(?i)ITEM\\s+\\d+[A-Z]?\\s*\\.?\\s*(.*)', 1)) END END AS name,
 CASE WHEN p THEN 'PART_' || regexp_extract(raw, '(?i)PART\\s+([IVX]+)', 1) ELSE regexp_extract(raw, '(?i)ITEM\\s+(\\d+[A-Z]?)', 1) END AS item_number FROM s WHERE p OR i),
c AS (SELECT doc_id, section, regexp_replace(string_agg(raw, chr(10) ORDER BY ln), '^\\s+|\\s+$', '', 'g') AS content FROM s WHERE section > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(section AS BIGINT) AS section, name, item_number, md5(content) AS content, char_offset, CAST(strlen(content) AS BIGINT) AS char_length FROM c JOIN h USING (doc_id, section)"""


def irc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents that open like statutes."""
    out = statutes.sections(I.headed(I.table(spark, sf_dir, "documents"), I.STATUTE_HEADS))
    return out.withColumn("content", F.md5("content")).withColumn("notes", F.md5("notes"))


IRC_SQL = f"""WITH docs AS ({I.headed_sql(I.STATUTE_HEADS)}), {I.LINES_SQL},
t AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS trimmed FROM lines),
u AS (SELECT *, starts_with(trimmed, '#') AS heading, regexp_replace(trimmed, '^#*\\s*', '') AS unmarked FROM t),
b AS (SELECT *, starts_with(unmarked, '**') AS bold, regexp_replace(regexp_replace(CASE WHEN starts_with(unmarked, '**') THEN ltrim(unmarked[3:]) ELSE unmarked END, '(\\*\\*)+$', ''), '\\s+$', '') AS plain FROM u),
o AS (SELECT *, regexp_matches(plain, '^(?:§{{1,2}}\\s*|SEC\\.\\s*|SECTION\\s+)(\\d+[A-Z]*(?:[-–]\\d+[A-Z]*)?)\\.\\s*(.*)$') AND (heading OR bold OR regexp_matches(plain, '\\.\\s*\\p{{Lu}}')) AS opens FROM b),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS section FROM o),
k AS (SELECT *, max(CASE WHEN (heading OR bold) AND NOT opens AND (plain IN ({', '.join(I.quoted(x) for x in statutes.NOTE_HEADINGS)}) OR starts_with(plain, 'Effective Date')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY ln ROWS UNBOUNDED PRECEDING) = 1 AS notes_ FROM s WHERE section > 0),
h AS (SELECT doc_id, section, off AS char_offset, '§' || regexp_extract(plain, '(\\d+[A-Z]*(?:[-–]\\d+[A-Z]*)?)\\.', 1) AS section_number, trim(regexp_extract(plain, '^[^.]*\\.\\s*(.*)$', 1)) AS title FROM k WHERE opens),
c AS (SELECT doc_id, section, regexp_replace(string_agg(raw, chr(10) ORDER BY ln) FILTER (NOT notes_), '^\\s+|\\s+$', '', 'g') AS content, regexp_replace(string_agg(raw, chr(10) ORDER BY ln) FILTER (notes_), '^\\s+|\\s+$', '', 'g') AS notes FROM k GROUP BY 1, 2)
SELECT doc_id, CAST(section AS BIGINT) AS section, section_number, title, lower(title[1:8]) = 'repealed' AS repealed, md5(content) AS content, md5(notes) AS notes, char_offset, CAST(strlen(content) AS BIGINT) AS char_length FROM c JOIN h USING (doc_id, section)"""


def irc_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions of documents that open like statutes."""
    out = statutes.provisions(I.headed(I.table(spark, sf_dir, "documents"), I.STATUTE_HEADS))
    return out.select("doc_id", "section", "position", "label", "title", F.md5("content").alias("content"))


def irc_structure_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statutes.headings(I.headed(I.table(spark, sf_dir, "documents"), I.STATUTE_HEADS))


def _heading_sql(label: str, pattern: str, count: int) -> str:
    return f"'{label} ' || nullif(regexp_extract(array_to_string(string_split(text, chr(10))[:{count}], ' '), '(?i){pattern}', 1), '')"


def roman_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of Roman and other tokens."""
    return spark.createDataFrame([(t,) for t in ROMANS], "token string").select("token", T.roman_value(F.col("token")).cast("long").alias("value"))


ROMANS = {"i": 1, "iv": 4, "IX": 9, "xl": 40, "MCMXCIV": 1994, "iix": 8, "abc": None, "": None}

QUERIES = {
    "compare_line_items": compare_line_items,
    "review_findings": review_findings,
    "review_summary": review_summary,
    "list_packages": list_packages,
    "review_memo": review_memo,
    "package_lookup": package_lookup,
    "tax_form_ladder": tax_form_ladder,
    "tax_form_counts": tax_form_counts,
    "tax_prefix_bytes": tax_prefix_bytes,
    "doc_lines_offsets": doc_lines_offsets,
    "sec_sections": sec_sections,
    "irc_sections": irc_sections,
    "irc_provisions": irc_provisions,
    "irc_structure_headings": irc_structure_headings,
    "roman_values": roman_values,
}

ORACLE_SQL = {
    "compare_line_items": COMPARE_SQL,
    "review_findings": FINDINGS_SQL,
    "review_summary": SUMMARY_SQL,
    "list_packages": LISTING_SQL,
    "review_memo": MEMO_SQL,
    "package_lookup": LOOKUP_SQL,
    "tax_form_ladder": _ladder_sql() + " SELECT doc_id, form_type, confidence, raw_match FROM said",
    "tax_form_counts": _ladder_sql() + " SELECT form_type, count(*) AS n, max(confidence) AS confidence FROM said GROUP BY 1",
    "tax_prefix_bytes": _ladder_sql().replace(I.headed_sql(I.FORM_HEADS), "SELECT doc_id, text FROM documents") + " SELECT doc_id, CAST(strlen(o) AS BIGINT) AS n_bytes, length(o) AS n_chars FROM opening",
    "doc_lines_offsets": f"WITH docs AS (SELECT doc_id, text FROM documents), {I.LINES_SQL} SELECT doc_id, ln, off, CAST(strlen(raw) AS BIGINT) AS n_bytes FROM lines",
    "sec_sections": SEC_SQL,
    "irc_sections": IRC_SQL,
    "irc_structure_headings": f"WITH docs AS ({I.headed_sql(I.STATUTE_HEADS)}) SELECT doc_id, " + ", ".join(f"{_heading_sql(label, p, n)} AS {name}" for name, label, p, n in statutes.HEADINGS) + " FROM docs",
    "roman_values": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if v is None else v})" for k, v in ROMANS.items()) + ") t(token, value)",
}
