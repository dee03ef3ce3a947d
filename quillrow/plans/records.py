"""Queries on regions, batches, page sets, findings, delimited text and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrow.functions import text as T
from quillrow.operators import batch, findings, layout, numberformats
from quillrow.plans import inputs as I
from quillrow.sources import files, tabular
from quillrow.streaming import triage


def region_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of a page a day, read within three boxes of each page."""
    e = I.table(spark, sf_dir, "events")
    items = e.select(F.lit(1).alias("doc"), (F.col("user_id") % 20).cast("int").alias("page"), F.col("value").alias("x"), (F.col("event_id") % 700).cast("double").alias("y"), F.col("event_id").cast("string").alias("text"))
    regions = spark.range(20).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("page")).withColumn("r", F.explode(F.expr("sequence(0, 2)"))).select("doc", "page", F.col("r").alias("region"), F.expr("array(r * 5.0D, r * 100.0D, r * 5.0D + 20.0D, r * 100.0D + 150.0D)").alias("box"))
    return layout.in_regions(items, regions, "doc", 50.0).select("page", "region", "n_items", F.md5("text").alias("text"))


REGIONS_SQL = """
WITH items AS (SELECT CAST(user_id % 20 AS INTEGER) AS page, value AS x, CAST(event_id % 700 AS DOUBLE) AS y, CAST(event_id AS VARCHAR) AS t FROM events),
regions AS (SELECT CAST(p AS INTEGER) AS page, CAST(r AS INTEGER) AS region FROM range(20) a(p), range(3) b(r)),
hits AS (SELECT g.page, g.region, y, x, t FROM items i JOIN regions g ON i.page = g.page AND x BETWEEN g.region * 5.0 AND g.region * 5.0 + 20 AND y BETWEEN g.region * 100.0 AND g.region * 100.0 + 150),
f AS (SELECT page, region, count(*) AS n_items, string_agg(t, ' ' ORDER BY y DESC, x, t) AS s FROM hits GROUP BY 1, 2)
SELECT page, region, coalesce(n_items, 0) AS n_items, md5(coalesce(s, '')) AS text FROM regions LEFT JOIN f USING (page, region)"""


def band_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order whose prices differ by 2,000 or less."""
    lines = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    return layout.band_pairs(lines, ["l_orderkey"], "price", 2000.0, "l_linenumber")


BAND_SQL = "WITH l AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2) SELECT a.l_orderkey, a.l_linenumber AS item_a, b.l_linenumber AS item_b, round(abs(a.p - b.p), 6) AS gap FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND abs(a.p - b.p) <= 2000"


def batch_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id asked for, a thousand ids' range a request and one more that isn't there: the document's size, or an error, in order."""
    ids = I.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.expr("doc_id div 1000").alias("request"), "doc_id")
    asked = ids.groupBy("request").agg(F.array_sort(F.collect_set("doc_id")).alias("paths")).withColumn("paths", F.concat("paths", F.array(F.lit(-1) - F.abs("request"))))
    sizes = I.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return batch.batch(asked, sizes, "doc_id").select("request", F.col("pos").cast("long").alias("pos"), "doc_id", "n_chars", "error")


BATCH_SQL = """
WITH d AS (SELECT doc_id // 1000 AS request, doc_id, n_chars FROM documents)
SELECT request, row_number() OVER (PARTITION BY request ORDER BY doc_id) - 1 AS pos, doc_id, n_chars, CAST(NULL AS VARCHAR) AS error FROM d
UNION ALL SELECT request, count(*) AS pos, -1 - abs(request) AS doc_id, NULL, 'not found' FROM d GROUP BY request"""


def top_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts of each brand, as fonts, the three with the most unmapped and then interpolated codes."""
    parts = I.table(spark, sf_dir, "part").select("p_brand", F.struct(F.col("p_size").alias("unmapped"), F.floor("p_retailprice").cast("long").alias("interpolated"), (-F.col("p_partkey")).alias("place"), "p_name").alias("font"))
    kept = parts.groupBy("p_brand").agg(batch.top(F.collect_list("font"), 3).alias("fonts"))
    return kept.select("p_brand", F.posexplode("fonts").alias("place", "f")).select("p_brand", (F.col("place") + 1).cast("long").alias("place"), "f.unmapped", "f.interpolated", "f.p_name")


FONTS_SQL = "SELECT p_brand, place, unmapped, interpolated, p_name FROM (SELECT p_brand, p_size AS unmapped, CAST(floor(p_retailprice) AS BIGINT) AS interpolated, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, CAST(floor(p_retailprice) AS BIGINT) DESC, p_partkey) AS place FROM part) WHERE place <= 3"


def page_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of lines by order: urgent and late ones, their union, what is wanted of it, and the rest."""
    lines = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("a"), F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("b")
    )
    wanted = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit(1), F.lit(2)))
    both = batch.pages_of(F.col("a"), F.col("b"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return lines.select("l_orderkey", joined(both).alias("pages"), joined(batch.only(both, wanted)).alias("wanted"), joined(F.array_except(batch.pages_of(F.col("a")), batch.pages_of(F.col("b")))).alias("rest"))


PAGES_SQL = """
WITH l AS (SELECT l_orderkey, coalesce(list(l_linenumber) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(l_linenumber) FILTER (l_linestatus = 'O'), []) AS b FROM lineitem GROUP BY 1),
u AS (SELECT *, list_sort(list_distinct(list_concat(a, b))) AS p FROM l)
SELECT l_orderkey, array_to_string(p, ',') AS pages, array_to_string(CASE WHEN l_orderkey % 2 = 0 THEN list_filter(p, lambda x: x IN (1, 2)) ELSE p END, ',') AS wanted, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), ',') AS rest FROM u"""

SAMPLES = [("comma", "a,b,c\n1,2,3\n4,5,6"), ("semicolon", "a;b\n1,5;2\n3;4"), ("tab", "a\tb\n1\t2"), ("pipe", "a|b|c\n1|2|3"), ("one", "alone\nwords"), ("tie", "a,b;c\n1,2;3")]
FILES = [("plain", "Date,Amount\n2025-01-02,1250.00\n", "| Date | Amount |\n|---|---|\n| 2025-01-02 | 1250.00 |\n", None), ("quoted", 'Name,Note\nx,"a | ""b"", c"\n', '| Name | Note |\n|---|---|\n| x | a \\| "b", c |\n', None), ("ragged", "a,b\n1\n", None, "malformed"), ("open", 'a,b\n"1,2\n', None, "malformed"), ("bare", 'a,b\n1"2,3\n', None, "malformed"), ("empty", "", None, "malformed"), ("marks", "a,b\n*x*,<y>\n", "| a | b |\n|---|---|\n| \\*x\\* | \\<y\\> |\n", None)]


def csv_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.best_delimiter(spark.createDataFrame(SAMPLES, "name string, text string"), "name", "text")


SNIFF_SQL = """
WITH s AS (SELECT * FROM (VALUES {values}) t(name, text)), d AS (SELECT * FROM (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) t(rank, delimiter)),
w AS (SELECT name, rank, delimiter, len(string_split(line, delimiter)) AS width FROM s, d, unnest(string_split(text, chr(10))) AS l(line) WHERE line <> ''),
n AS (SELECT name, rank, delimiter, width, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT name, rank, delimiter, max(n * 1000 + CASE WHEN width >= 2 THEN least(width, 500) ELSE -1000000 END) AS score FROM n GROUP BY ALL)
SELECT name, arg_max(delimiter, (greatest(score, 0), -rank)) AS delimiter FROM m GROUP BY 1""".replace("{values}", ", ".join(f"({I.quoted(n)}, {I.quoted(t)})" for n, t in SAMPLES).replace("\t", "' || chr(9) || '"))


def csv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, bytearray(t.encode())) for n, t, _, _ in FILES], "name string, content binary")
    return tabular.converted(rows).select("name", "markdown", "error")


CSV_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({I.quoted(n)}, {I.quoted(m) if m else 'NULL'}, {I.quoted(e) if e else 'NULL'})" for n, _, m, e in FILES) + ") t(name, markdown, error)"

DATES = [("D:20250102030405Z", True), (" D:2025 ", True), ("D:20250102030405+01'00'", True), ("2025-01-02", False), ("D:20", False)]


def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d, _ in DATES], "said string").select("said", T.pdf_date(F.col("said")).alias("date"))


DATES_SQL = "SELECT said, CASE WHEN good THEN trim(said) END AS date FROM (VALUES " + ", ".join(f"({I.quoted(d)}, {g})" for d, g in DATES) + ") t(said, good)"


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that more than one document has."""
    d = I.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's fifty most frequent words (ties by first place) that the benchmark has."""
    clean = lambda c: F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " ")), " ")
    words = I.table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(clean("text")).alias("pos", "word")).where("word <> ''")
    counted = words.groupBy("source", "word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("at"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "at"))).where("k <= 50")
    known = I.table(spark, sf_dir, "benchmark").select(F.explode(clean("text")).alias("word")).distinct().withColumn("hit", F.lit(1))
    return top.join(known, "word", "left").groupBy("source").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


RECALL_SQL = """
WITH c AS (SELECT source, doc_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
x AS (SELECT source, doc_id, i AS pos, w[i] AS word FROM c, unnest(range(1, len(w) + 1)) t(i) WHERE w[i] <> ''),
n AS (SELECT source, word, count(*) AS n, min((doc_id, pos)) AS at_ FROM x GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, at_) AS k FROM n),
b AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ')) AS word FROM benchmark)
SELECT source, round(avg(CASE WHEN b.word IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM k LEFT JOIN b USING (word) WHERE k <= 50 GROUP BY 1"""

_CODES_SQL = "[" + ", ".join(f"'{c}'" for c in findings.CODES) + "]"


def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of documents from findings made of their ids and texts."""
    docs = I.table(spark, sf_dir, "documents")
    codes = F.array(*map(F.lit, findings.CODES))
    made = docs.select("doc_id", F.explode(F.expr("sequence(0L, doc_id % 5)")).alias("i"), F.substring("text", 1, 8).alias("text")).select("doc_id", (F.col("i") % 3 + 1).alias("page"), codes[((F.col("doc_id") + F.col("i") * 7) % len(findings.CODES)).cast("int")].alias("code"), "text", (F.col("doc_id") % 2 == 0).alias("shown"))
    out = findings.warnings(findings.decided(made))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "code", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


WARNINGS_SQL = f"""
WITH m AS (SELECT doc_id, i % 3 + 1 AS page, {_CODES_SQL}[(doc_id + i * 7) % {len(findings.CODES)} + 1] AS code, substr(text, 1, 8) AS t, doc_id % 2 = 0 AS shown FROM documents, unnest(range(0, doc_id % 5 + 1)) x(i)),
d AS (SELECT * FROM m WHERE CASE WHEN code IN ('form_values_misread', 'annotation_text_unread') THEN NOT shown AND t IS NOT NULL WHEN code IN ('hidden_layer_text_read', 'invisible_text_read', 'offpage_text_read') THEN shown AND length(t) >= 6 ELSE true END)
SELECT doc_id, CAST(list_position({_CODES_SQL}, code) AS BIGINT) AS ord, code, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM d GROUP BY doc_id, code"""


def ocr_reason_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by page, with one more for some pages, known or not."""
    pages = I.table(spark, sf_dir, "pages").where("page_id % 3 = 0").select("page_id", F.array(F.lit("scanned"), F.lit("no_text")).alias("reasons"))
    unseen = I.table(spark, sf_dir, "pages").where("page_id % 4 = 0").select("page_id")
    return findings.with_reason(pages, unseen, ["page_id"]).select("page_id", F.array_join("reasons", ",").alias("reasons"))


UPSERT_SQL = "SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 4 = 0 THEN 'invisible_text_layer,no_text,scanned' WHEN page_id % 3 = 0 THEN 'no_text,scanned' ELSE 'invisible_text_layer' END AS reasons FROM pages WHERE page_id % 3 = 0 OR page_id % 4 = 0"


def notice_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as short as a notice on one page and on two."""
    t = F.col("text")
    return I.table(spark, sf_dir, "documents").select("doc_id", findings.notice_only(t, F.lit(1)).alias("one_page"), findings.notice_only(t, F.lit(2), "the").alias("two_pages"))


NOTICE_SQL = "WITH w AS (SELECT doc_id, text, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END AS n FROM documents) SELECT doc_id, n <= 150 AS one_page, n <= CASE WHEN contains(text, 'the') THEN 1200 ELSE 300 END AS two_pages FROM w"


def detection_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median, mean and greatest value of each type of event, as of detection times."""
    e = I.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg(F.col("value").cast("decimal(20,8)")).cast("double"), 5).alias("mean"), F.round(F.max("value"), 6).alias("greatest"))


ROLLUP_SQL = "SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(median(value), 6) AS median, round(CAST(sum(CAST(value AS DECIMAL(20,8))) / count(*) AS DOUBLE), 5) AS mean, round(max(value), 6) AS greatest FROM events GROUP BY 1"


def capability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("pdf",), ("xlsb",), ("what",)], "kind string")
    return files.capability(asked)


CAPABILITY_SQL = "SELECT * FROM (VALUES ('pdf', true, 'classify,markdown,layout,regions', NULL), ('xlsb', false, '', NULL), ('what', NULL, NULL, 'unrecognized')) t(kind, enabled, operations, error)"


def signature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages' bytes with a signature put before some, by bytes and then by name."""
    p = I.table(spark, sf_dir, "pages")
    head = F.element_at(F.array(*map(F.lit, ["25504446" + "2D", "504B0304", "D0CF11E0A1B11AE1", "", ""])), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.when(F.col("page_id") % 5 == 4, "x.CSV").otherwise("x.bin")
    return p.select("page_id", files.kind_of(F.concat(F.unhex(head), F.encode("html", "UTF-8")), path).alias("kind"))


SIGNATURE_SQL = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'ole' WHEN 4 THEN 'csv' END AS kind FROM pages"

FORMATS = [(38, None, -5.0, False, False), (0, "#,##0;[Red]#,##0", -5.0, False, True), (0, "0;-0", -5.0, False, False), (0, ";;;", 5.0, True, False), (0, ";;;", None, True, False), (27, None, 5.0, False, True), (14, None, 5.0, False, False), (0, "0.00;[Red]0.00", -0.001, False, False), (0, "# ?/?,", 0.2, False, True)]


def numfmt_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What number formats lose."""
    cells = spark.createDataFrame([(n, *r[:3]) for n, r in enumerate(FORMATS)], "n int, format_id int, code string, value double")
    return numberformats.losses(cells).select("n", "hidden", "misrendered")


FORMATS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({n}, {r[3]}, {r[4]})" for n, r in enumerate(FORMATS)) + ") t(n, hidden, misrendered)"


def events_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, as the stream would sum them."""
    return triage.windowed(I.table(spark, sf_dir, "events"))


WINDOWED_SQL = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions with gaps of 30 minutes."""
    return triage.sessions(I.table(spark, sf_dir, "events"))


SESSIONS_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = {
    "numfmt_loss": numfmt_loss,
    "events_windowed": events_windowed,
    "events_sessions": events_sessions,
    "region_items": region_items,
    "band_join_pairs": band_join_pairs,
    "batch_contract": batch_contract,
    "top_fonts": top_fonts,
    "page_set_algebra": page_set_algebra,
    "csv_sniff": csv_sniff,
    "csv_to_markdown": csv_to_markdown,
    "pdf_dates": pdf_dates,
    "exact_duplicates": exact_duplicates,
    "keyword_recall": keyword_recall,
    "page_warnings": page_warnings,
    "ocr_reason_upsert": ocr_reason_upsert,
    "notice_only": notice_only,
    "detection_rollup": detection_rollup,
    "capability_lookup": capability_lookup,
    "signature_kinds": signature_kinds,
}

ORACLE_SQL = {
    "numfmt_loss": FORMATS_SQL,
    "events_windowed": WINDOWED_SQL,
    "events_sessions": SESSIONS_SQL,
    "region_items": REGIONS_SQL,
    "band_join_pairs": BAND_SQL,
    "batch_contract": BATCH_SQL,
    "top_fonts": FONTS_SQL,
    "page_set_algebra": PAGES_SQL,
    "csv_sniff": SNIFF_SQL,
    "csv_to_markdown": CSV_SQL,
    "pdf_dates": DATES_SQL,
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "keyword_recall": RECALL_SQL,
    "page_warnings": WARNINGS_SQL,
    "ocr_reason_upsert": UPSERT_SQL,
    "notice_only": NOTICE_SQL,
    "detection_rollup": ROLLUP_SQL,
    "capability_lookup": CAPABILITY_SQL,
    "signature_kinds": SIGNATURE_SQL,
}
