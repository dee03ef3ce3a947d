"""Which tax form a text is: an ordered ladder of patterns over its first 5,000 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrow.functions import text as T

#: Bytes of the text that are looked at.
OPENING = 5000

# Pattern, form type, confidence, in the order in which they are tried. Patterns ignore case.
RULES = [
    (r"Form\s+1099\s+Composite", "form1099_composite", 1.0),
    (r"^#+\s*W-2\s+Transcript", "w2", 0.95),
    (r"^#+\s*1099-INT\s+Transcript", "form1099_int", 0.95),
    (r"^#+\s*1099-DIV\s+Transcript", "form1099_div", 0.95),
    (r"^#+\s*1099-MISC\s+Transcript", "form1099_misc", 0.95),
    (r"^#+\s*1099-NEC\s+Transcript", "form1099_nec", 0.95),
    (r"Schedule\s+K-1.*Form\s+1065", "k1_1065", 1.0),
    (r"Schedule\s+K-1.*Form\s+1120-S", "k1_1120_s", 1.0),
    (r"Form\s+W-2", "w2", 1.0),
    (r"Wage\s+and\s+Tax\s+Statement", "w2", 0.9),
    (r"Form\s+1099-INT", "form1099_int", 1.0),
    (r"Interest\s+Income", "form1099_int", 0.7),
    (r"Form\s+1099-DIV", "form1099_div", 1.0),
    (r"Dividends\s+and\s+Distributions", "form1099_div", 0.7),
    (r"Form\s+1099-MISC", "form1099_misc", 1.0),
    (r"Form\s+1099-NEC", "form1099_nec", 1.0),
    (r"Nonemployee\s+Compensation", "form1099_nec", 0.8),
    (r"Schedule\s+A.*Itemized\s+Deductions", "schedule_a", 1.0),
    (r"Schedule\s+C.*Profit\s+or\s+Loss", "schedule_c", 1.0),
    (r"Schedule\s+D.*Capital\s+Gains", "schedule_d", 1.0),
    (r"Schedule\s+E.*Supplemental\s+Income", "schedule_e", 1.0),
    (r"Form\s+1040", "form1040", 1.0),
    (r"U\.S\.\s*Individual\s+Income\s+Tax\s+Return", "form1040", 1.0),
    (r"Form\s+1065", "form1065", 1.0),
    (r"U\.S\.\s*Return\s+of\s+Partnership\s+Income", "form1065", 1.0),
    (r"Form\s+1120-S", "form1120_s", 1.0),
    (r"U\.S\.\s*Income\s+Tax\s+Return\s+for\s+an\s+S\s+Corporation", "form1120_s", 1.0),
    (r"Form\s+1120", "form1120", 1.0),
    (r"U\.S\.\s*Corporation\s+Income\s+Tax\s+Return", "form1120", 1.0),
]


def first_match(opening: Column) -> Column:
    """STRUCT<form_type, confidence, raw_match> of the first rule that matches, else null."""
    tried = [F.struct(F.lit(form).alias("form_type"), F.lit(confidence).alias("confidence"), F.regexp_substr(opening, F.lit(f"(?imd){pattern}")).alias("raw_match")) for pattern, form, confidence in RULES]
    return F.try_element_at(F.filter(F.array(*tried), lambda x: x["raw_match"].isNotNull()), F.lit(1))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Form of each row; a text without a match, or null, is unknown."""
    opened = docs.select(key, T.byte_prefix(F.coalesce(text, F.lit("")), OPENING).alias("opening"))
    best = opened.select(key, first_match(F.col("opening")).alias("best"))
    return best.select(key, F.coalesce("best.form_type", F.lit("unknown")).alias("form_type"), F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("best.raw_match", F.lit("")).alias("raw_match"))
