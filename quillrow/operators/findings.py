"""Page findings: from rows of detected things to ordered warnings, and how they change a page's reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Warning codes in the order in which they are reported.
CODES = [
    "form_values_misread", "annotation_text_unread", "annotation_text_unchecked", "hidden_layer_text_read", "invisible_text_read", "offpage_text_read", "cjk_text_misread", "vertical_text_misread", "pages_unchecked", "xfa_form_unread", "embedded_files_unread",
    "word_gaps_misread", "form_text_unread", "visible_text_unread", "dense_content_unread", "actual_text_differs", "text_painted_twice", "table_row_repeated", "table_values_merged", "table_values_detached", "header_footer_dropped",
]
# Codes that hold where their text is missing, and where it is shown.
IF_UNSHOWN = ["form_values_misread", "annotation_text_unread"]
IF_SHOWN = ["hidden_layer_text_read", "invisible_text_read", "offpage_text_read"]
# Words of a page that says no more than a notice, and reasons that only the scan can give.
NOTICE_WORDS, UNSEEN = 150, "invisible_text_layer"


def decided(findings: DataFrame, shown: str = "shown") -> DataFrame:
    """Findings (doc, page, code, text, shown) that stand: text codes by whether the text is shown, all others always."""
    c, s = F.col("code"), F.col(shown)
    return findings.where(F.when(c.isin(IF_UNSHOWN), ~s & F.col("text").isNotNull()).when(c.isin(IF_SHOWN), s & (F.length(F.col("text")) >= 6)).otherwise(True))


def warnings(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document and code: ord (the order of report), code, pages (sorted, each once)."""
    ranks = F.array_position(F.array(*map(F.lit, CODES)), F.col("code")).cast("int")
    return findings.where(F.col("code").isin(CODES)).groupBy(doc, "code").agg(F.array_sort(F.collect_set("page")).alias("pages")).withColumn("ord", ranks)


def with_reason(pages: DataFrame, unseen: DataFrame, keys: list[str]) -> DataFrame:
    """Reasons by page with one more for the pages of `unseen`, which may be pages without a row."""
    more = unseen.select(*keys).distinct().withColumn("more", F.array(F.lit(UNSEEN)))
    none = F.array().cast("array<string>")
    return pages.join(more, keys, "full").select(*keys, F.array_sort(F.array_union(F.coalesce("reasons", none), F.coalesce("more", none))).alias("reasons"))


def notice_only(text: Column, pages: Column, notice: str | None = None) -> Column:
    """Whether a text is as short as a notice; four times as long where it holds the notice's phrase."""
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    most = F.lit(NOTICE_WORDS) * F.greatest(pages, F.lit(1))
    return words <= (F.when(F.contains(text, F.lit(notice)), most * 4).otherwise(most) if notice else most)
