"""Sections of annual and quarterly filings: PART and ITEM headings start them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrow.functions import text as T

PART = r"(?id)^\s*#{0,4}\s*\*{0,2}\s*PART\s+([IVX]+)\s*\*{0,2}\s*$"
ITEM = r"(?id)^\s*#{0,4}\s*\*{0,2}\s*ITEM\s+([0-9]+[A-Z]?)\s*\.?\s*(.*)"


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section: key, section (from 1), name, item_number, content, char_offset, char_length.

    Offsets and lengths count UTF-8 bytes. What stands before the first heading is left out. A PART
    heading is tried before an ITEM one.
    """
    line = T.lines(docs, key, text).withColumn("raw", F.regexp_replace("raw", "\r$", ""))
    is_part, is_item = F.col("raw").rlike(PART), F.col("raw").rlike(ITEM)
    number, title = F.regexp_extract("raw", ITEM, 1), F.trim(F.regexp_extract("raw", ITEM, 2))
    part = F.regexp_extract("raw", PART, 1)
    item_name = F.when(title == "", F.concat(F.lit("Item "), number)).otherwise(F.concat(F.lit("Item "), number, F.lit(" - "), title))
    marked = line.withColumn("head", is_part | is_item).withColumn("item_number", F.when(is_part, F.concat(F.lit("PART_"), part)).when(is_item, number)).withColumn("name", F.when(is_part, F.trim("raw")).when(is_item, item_name))
    run = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    each = marked.withColumn("section", F.sum(F.col("head").cast("int")).over(run)).where(F.col("section") > 0)
    content = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "raw"))), lambda x: x["raw"]), "\n"))
    whole = F.regexp_replace(content, r"^\s+|\s+$", "")
    out = each.groupBy(key, "section").agg(whole.alias("content"), F.min(F.when(F.col("head"), F.col("off"))).alias("char_offset"), F.max("name").alias("name"), F.max("item_number").alias("item_number"))
    return out.select(key, F.col("section").cast("long").alias("section"), "name", "item_number", "content", "char_offset", F.octet_length("content").cast("long").alias("char_length"))
