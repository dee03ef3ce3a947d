"""Tie-out of return amounts against source amounts, findings, summaries and memos.

Everything works on tables of any number of packages: line items and advisories are rows keyed by
package, and each result is one aggregation over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.sources import packages

# Fixed values of the contract.
CRITICAL_FROM, MISMATCH_CONFIDENCE, ADVISORY_CONFIDENCE = 1000, 0.92, 0.74


def compare(items: DataFrame) -> DataFrame:
    """Adds tolerance (never negative), difference, absolute_difference, status, severity and message.

    Reads label, return_reference, source_reference, return_amount, source_amount and tolerance.
    """
    out = items.withColumn("tolerance", F.greatest(F.coalesce("tolerance", F.lit(0)), F.lit(0)).cast("long"))
    out = out.withColumn("difference", F.col("return_amount") - F.col("source_amount")).withColumn("absolute_difference", F.abs("difference"))
    ties = F.col("absolute_difference") <= F.col("tolerance")
    severity = F.when(ties, "info").when(F.col("absolute_difference") >= CRITICAL_FROM, "critical").otherwise("warning")
    same = F.format_string("%s ties within tolerance: return %d vs source %d.", "label", "return_amount", "source_amount")
    apart = F.format_string("%s differs by %d: return %d at %s vs source %d at %s.", "label", "difference", "return_amount", "return_reference", "source_amount", "source_reference")
    return out.withColumn("status", F.when(ties, "pass").otherwise("flag")).withColumn("severity", severity).withColumn("message", F.when(ties, same).otherwise(apart))


def compare_tables(returns: DataFrame, sources: DataFrame, key: str, tolerance: int = 0) -> DataFrame:
    """Line items of two tables (key, amount, reference), each missing side as zero, compared."""
    both = returns.select(key, F.col("amount").alias("return_amount"), F.col("reference").alias("return_reference")).join(sources.select(key, F.col("amount").alias("source_amount"), F.col("reference").alias("source_reference")), key, "full")
    zero, none = F.lit(0).cast("long"), F.lit("missing")
    return compare(both.select(F.col(key).cast("string").alias("label"), F.coalesce("return_amount", zero).alias("return_amount"), F.coalesce("source_amount", zero).alias("source_amount"), F.coalesce("return_reference", none).alias("return_reference"), F.coalesce("source_reference", none).alias("source_reference"), F.lit(tolerance).alias("tolerance")))


def findings(items: DataFrame, advisories: DataFrame) -> DataFrame:
    """Flagged line items and then advisories of each package, numbered F-001 and on."""
    flagged = compare(items).where(F.col("status") == "flag").select("package_id", F.lit(0).alias("part"), "position", "severity", "category", F.concat("label", F.lit(" does not tie")).alias("title"), F.col("message").alias("detail"), "return_reference", "source_reference", "recommended_action", F.lit(MISMATCH_CONFIDENCE).alias("confidence"))
    given = advisories.select("package_id", F.lit(1).alias("part"), "position", "severity", "category", "title", "detail", "return_reference", F.lit(None).cast("string").alias("source_reference"), "recommended_action", F.lit(ADVISORY_CONFIDENCE).alias("confidence"))
    number = F.row_number().over(_by("part", "position"))
    return flagged.unionByName(given).withColumn("number", number).withColumn("finding_id", F.format_string("F-%03d", "number")).drop("part", "position")


def _by(*order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("package_id").orderBy(*order)


def summaries(items: DataFrame, advisories: DataFrame) -> DataFrame:
    """Counts and the confidence score of each package that has a check."""
    rows = compare(items).select("package_id", "severity", (F.col("status") == "pass").alias("passed")).unionByName(advisories.select("package_id", "severity", F.lit(False).alias("passed")))
    count = lambda c: F.count_if(c).alias
    open_ = ~F.col("passed")
    out = rows.groupBy("package_id").agg(
        count(open_)("total_findings"), *[count(open_ & (F.col("severity") == s))(s) for s in ("critical", "warning", "info")], count(F.col("passed"))("checks_passed"), F.count("*").alias("checks_total")
    )
    return out.withColumn("confidence_score", score("checks_passed", "checks_total"))


def score(passed: str, total: str) -> Column:
    """min(passed / total * 0.25 + 0.72, 0.97) in single precision, 0 without checks."""
    f = lambda x: F.lit(x).cast("float")
    share = (F.col(passed).cast("float") / F.col(total).cast("float")).cast("float")
    made = ((share * f(0.25)).cast("float") + f(0.72)).cast("float")
    return F.when(F.col(total) == 0, f(0.0)).otherwise(F.least(made, f(0.97)))


def listing(spark: SparkSession) -> DataFrame:
    """Every package with its numbers of forms, sources, checks and expected findings."""
    docs = packages.table(spark, "documents").groupBy("package_id").agg(F.count_if(F.col("role") == "form").alias("form_count"), F.count_if(F.col("role") == "source").alias("source_doc_count"))
    checks = summaries(packages.table(spark, "line_items"), packages.table(spark, "advisories")).select("package_id", F.col("checks_total").alias("check_count"), F.col("total_findings").alias("expected_findings"))
    zero = {c: 0 for c in ("form_count", "source_doc_count", "check_count", "expected_findings")}
    return packages.table(spark, "packages").join(docs, "package_id", "left").join(checks, "package_id", "left").fillna(zero)


def looked_up(spark: SparkSession, asked: DataFrame) -> DataFrame:
    """Asked package ids with their title, or an error that doesn't repeat the input."""
    found = asked.join(F.broadcast(packages.table(spark, "packages")), "package_id", "left")  # six rows
    return found.withColumn("error", F.when(F.col("title").isNull(), "unknown demo package"))


def memos(spark: SparkSession) -> DataFrame:
    """(package_id, memo): the Markdown memo of every built-in package."""
    items, advisories = packages.table(spark, "line_items"), packages.table(spark, "advisories")
    name = F.initcap("severity")
    source = F.when(F.col("source_reference").isNotNull(), F.concat(F.lit("- Source: "), "source_reference", F.lit("\n"))).otherwise("")
    one = F.concat(F.lit("### "), "finding_id", F.lit(" - "), name, F.lit(": "), "title", F.lit("\n"), "detail", F.lit("\n\n- Return: "), "return_reference", F.lit("\n"), source, F.lit("- Action: "), "recommended_action", F.lit("\n\n"))
    listed = findings(items, advisories).select("package_id", "number", one.alias("block")).groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda x: x["block"]), "").alias("blocks"))
    head = F.format_string("# Tax Review Memo - %s (%s, TY %d)\n\n## Summary\n- Findings: %d (%d critical, %d warning, %d info)\n- Checks passed: %d of %d\n- Confidence score: %d%%\n\n## Findings\n", "title", "return_type", "tax_year", "total_findings", "critical", "warning", "info", "checks_passed", "checks_total", F.bround((F.col("confidence_score") * F.lit(100).cast("float")).cast("float")).cast("int"))
    tail = "## Skipped Checks\n" + "".join(f"- {x}\n" for x in packages.SKIPPED_CHECKS) + "\n## Next Steps\n" + "".join(f"- {x}\n" for x in packages.NEXT_STEPS)
    rows = packages.table(spark, "packages").join(summaries(items, advisories), "package_id").join(listed, "package_id", "left")
    return rows.select("package_id", F.concat(head, F.coalesce("blocks", F.lit("- No findings above tolerance.\n")), F.lit(tail)).alias("memo"))
