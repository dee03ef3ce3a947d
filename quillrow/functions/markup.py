"""Column functions on marked-up text: truncation, pieces of a line, strict Roman numerals, conditions, links and entities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs, names of characters, and what bytes 128 to 159 say in Windows-1252 (a space: as in Latin-1).
CURRENCY = "[$€£¥]"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
WINDOWS_1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
_ENTITY = r"(&(?:amp|lt|gt|quot|apos|nbsp|#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9});|[^&]+|&)"
_CANONICAL = "^m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
_LINK = r"(`[^`]*`)|!?\[([^\]]*)\]\([^)]*\)|</?[A-Za-z][^>]*>"
_CONDITION = r"^\s*value\(\)\s*(<=|>=|!=|<>|<|>|=)\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"


def truncated(text: Column, most: int) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, most)


def has_currency(text: Column) -> Column:
    """Whether a text holds a currency sign."""
    return text.rlike(CURRENCY)


def height_bucket(y: Column) -> Column:
    """A height's key, in tenths of a point, halves away from zero."""
    return F.round(y * 10).cast("int")


def line_pieces(text: Column) -> Column:
    """Runs of digits, of letters, and of what lies between."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+|\p{L}+|[^0-9\p{L}]+)"), 1)


def roman_strict(word: Column) -> Column:
    """Value of a Roman numeral of up to 12 letters in one case, in its own spelling; null of any other word."""
    low = F.lower(word)
    each = lambda c: F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))
    total = sum((each(c) * v for c, v in {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}.items()), F.lit(0))
    # A letter before a greater one counts against it, so twice less than in the sum.
    for pairs, v in (("c[md]", 200), ("x[cl]", 20), ("i[xv]", 2)):
        total = total - F.when(low.rlike(pairs), v).otherwise(0)
    fits = F.length(word).between(1, 12) & low.rlike(_CANONICAL) & ((word == low) | (word == F.upper(word)))
    return F.when(fits, total.cast("long"))


def condition_holds(condition: Column, value: Column) -> Column:
    """Whether `value()` compared with a number holds; null of what is no such condition."""
    sign, number = F.regexp_extract(condition, _CONDITION, 1), F.nullif(F.regexp_extract(condition, _CONDITION, 2), F.lit("")).cast("double")
    ways = {"<=": value <= number, ">=": value >= number, "!=": value != number, "<>": value != number, "<": value < number, ">": value > number, "=": value == number}
    return F.coalesce(*[F.when(sign == s, holds) for s, holds in ways.items()])


def unlinked(markdown: Column) -> Column:
    """Markdown without the targets of its links and without HTML tags; code spans stay as they are."""
    return F.regexp_replace(markdown, _LINK, "$1$2")


def entities(text: Column) -> Column:
    """A text with named and numbered characters decoded, each once; what names none stays."""

    def decoded(piece: Column) -> Column:
        number = F.when(piece.rlike("^&#[xX]"), F.conv(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)).when(piece.rlike("^&#[0-9]"), F.regexp_extract(piece, "^&#([0-9]+);$", 1)).cast("long")
        character = F.when((number < 0x110000) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        named = F.coalesce(*[F.when(piece == f"&{k};", F.lit(v)) for k, v in ENTITIES.items()])
        return F.coalesce(named, character, piece)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), 1), decoded), "")


def plain(rich: Column) -> Column:
    """The text of rich text: tags left out, also one that doesn't end, and characters decoded."""
    return entities(F.regexp_replace(rich, "<[^>]*(?:>|$)", ""))


def read_bytes(data: bytes | None) -> str | None:
    """A string's bytes as text: UTF-16 by its mark or its many zeros, UTF-8 where it is, else Windows-1252."""
    if data is None:
        return None
    if data.startswith(b"\xfe\xff"):
        return data[2 : len(data) // 2 * 2].decode("utf-16-be", "replace")
    if len(data) >= 4 and len(data) % 2 == 0 and 4 * data.count(0) > len(data):
        said = data.decode("utf-16-be", "replace")
        if all(c.isprintable() or c.isspace() for c in said):
            return said
    if max(data, default=0) > 127:
        try:
            return data.decode()
        except UnicodeDecodeError:
            pass
    return "".join(WINDOWS_1252[b - 128] if 128 <= b < 160 and WINDOWS_1252[b - 128] != " " else chr(b) for b in data)


def decoded_bytes(data: Column) -> Column:
    """`read_bytes` of a binary column, on Arrow batches."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([read_bytes(None if x is None else bytes(x)) for x in batch], dtype=object)

    return read(data)
