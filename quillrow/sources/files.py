"""Files as rows: bounded binary scans, their kinds by signature, and the capabilities of each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the largest file that is read.
MOST_BYTES = 50 * 1024 * 1024

# Kind, first bytes in hex, whether the lane is on.
SIGNATURES = [("pdf", "255044462D", True), ("zip", "504B0304", True), ("ole", "D0CF11E0A1B11AE1", False), ("rtf", "7B5C727466", False), ("png", "89504E47", False), ("jpeg", "FFD8FF", False)]
# Kind, main part in a package, whether the lane is on.
PACKAGES = [("docx", "word/document.xml", True), ("pptx", "ppt/presentation.xml", True), ("xlsx", "xl/workbook.xml", True)]
# Extension, kind, for text that has no signature.
EXTENSIONS = [("csv", "csv"), ("tsv", "csv"), ("md", "markdown"), ("txt", "text")]
# Kind, whether it is on, what is done with it.
CAPABILITIES = [
    ("pdf", True, "classify,markdown,layout,regions"), ("docx", True, "classify,markdown"), ("pptx", True, "classify,markdown"), ("xlsx", True, "classify,markdown"), ("ods", True, "classify,markdown"), ("odt", True, "classify,markdown"), ("odp", True, "classify,markdown"), ("epub", True, "classify,markdown"), ("csv", True, "classify,markdown"),
    ("rtf", False, ""), ("doc", False, ""), ("docm", False, ""), ("ppt", False, ""), ("pptm", False, ""), ("xls", False, ""), ("xlsm", False, ""), ("xlsb", False, ""), ("image", False, ""),
]


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length and content of files; the content of too large ones isn't read and their row has an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    # Pushed down: the file isn't opened.
    fit = files.where(F.col("length") <= MOST_BYTES).select("path", "length", "content", F.lit(None).cast("string").alias("error"))
    over = files.where(F.col("length") > MOST_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("resource_limit").alias("error"))
    return fit.unionByName(over)


def kind_of(content: Column, path: Column) -> Column:
    """Kind by the first bytes, else by extension, else null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for ext, kind in reversed(EXTENSIONS):
        out = F.when(F.lower(path).endswith(f".{ext}"), kind).otherwise(out)
    for kind, first, _ in reversed(SIGNATURES):
        out = F.when(F.startswith(head, F.lit(first)), kind).otherwise(out)
    return out


def package_kind(members: Column) -> Column:
    """Kind of a package by its members' names; encrypted ones and those with macros are refused first."""
    has = lambda name: F.array_contains(members, name)
    out = F.lit("unrecognized")
    for kind, main, _ in reversed(PACKAGES):
        out = F.when(has(main), kind).otherwise(out)
    macro = F.exists(members, lambda m: F.lower(m).endswith("vbaproject.bin"))
    return F.when(has("EncryptedPackage"), "encrypted").when(macro, "active_content_disabled").otherwise(out)


def capabilities(spark: SparkSession) -> DataFrame:
    """kind, enabled, operations of every kind."""
    return spark.createDataFrame(CAPABILITIES, "kind string, enabled boolean, operations string")


def capability(asked: DataFrame) -> DataFrame:
    """Asked kinds with their capability, or an error."""
    out = asked.join(F.broadcast(capabilities(asked.sparkSession)), "kind", "left")  # a row a kind
    return out.withColumn("error", F.when(F.col("enabled").isNull(), "unrecognized"))


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as JSON; a row with an error as its error alone."""
    whole = F.to_json(F.struct(*[c for c in rows.columns if c not in (key, "error")]))
    failed = F.to_json(F.struct("error")) if "error" in rows.columns else F.lit(None)
    error = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    return rows.select(key, F.when(error, failed).otherwise(whole).alias("json"))
