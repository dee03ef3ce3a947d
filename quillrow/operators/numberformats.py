"""What a spreadsheet cell's number format loses when its shown text becomes Markdown.

A value may be hidden by its format, or shown as something else: a negative one marked by colour
alone, or a date as its serial number.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Built-in format ids and their codes.
BUILTIN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
# Built-in ids without a code that stand for locale dates and percentages.
LOCALE_IDS = frozenset([*range(27, 37), *range(50, 59), 67, 68, *range(71, 82)])
# Characters and words that mark a negative value, and colour names.
SIGN_MARKS = "-()−‒–﹣－（）"
SIGN_WORDS = ("CR", "DR")
COLOURS = ("black", "blue", "cyan", "green", "magenta", "red", "white", "yellow")

# Kinds of the tokens of a code and the letter that each has in a section's shape; what shows nothing has none, and "!"
# is what no section may hold. A bracket's letter depends on what is in it, see `_bracket`.
_KINDS = [
    ("quoted", r'"[^"]*"', "x"), ("bracket", r"\[[^\]]*\]", ""), ("escaped", r"\\.", "x"), ("width", r"_.", "w"), ("fill", r"\*.", ""), ("open", r'["\[\\_*]', "!"),
    ("cut", ";", ""), ("half", r"AM/PM|A/P", "d"), ("general", "General", "G"), ("power", r"E[+-]", "E"), ("place", r"[0#?]", "0"), ("number", r"[1-9][0-9]*", "1"), ("point", r"\.", "."),
    ("comma", ",", ","), ("percent", "%", "%"), ("text", "@", "@"), ("bar", "/", "/"), ("date", "[ydmhs]", "d"), ("mark", r"[$+():\s-]", "x"), ("other", ".", "!"),
]
_TOKEN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in _KINDS), re.S | re.I)
_LETTER = {name: letter for name, _, letter in _KINDS}
# Shapes that are no section: strange tokens, two conditions, General or text beside a number, dates beside text or a
# power, and fractions with a point, a power or nothing below the bar.
_BAR = r"^[^.]*?0/"
_NO_SECTION = re.compile("!|c.*c|(?=.*G).*[0.E1@/,%]|^(?!.*G)(?=.*d).*[@E1]|^(?!.*[Gd])(?=.*@).*[0.E1/]|" + f"{_BAR}(?!.*[01])|{_BAR}.*[.E]|{_BAR}1.*0")
#: Which section shows a positive value, zero and a negative one, by the number of sections for numbers.
_SHOWS = {1: (0, 0, 0), 2: (0, 0, 1), 3: (0, 2, 1)}


def _bracket(inner: str) -> tuple[str, str]:
    """Letter and literal of what a bracket holds."""
    said = inner.lower()
    if m := re.fullmatch(r"\$([^-]*).*", inner, re.S):
        return ("x", m[1]) if m[1] else ("", "")
    if re.fullmatch(r"[<>=]+\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*", said):
        return "c", ""
    if re.fullmatch("h+|m+|s+", said):
        return "d", ""
    numbered = re.fullmatch(r"color\s*(\d+)\s*", said)
    return ("k" if said in COLOURS or (numbered and 1 <= int(numbered[1]) <= 56) else "!"), ""


def _signed(literal: str) -> bool:
    return any(c in SIGN_MARKS for c in literal) or any(w.upper() in SIGN_WORDS for w in re.split(r"[\W\d_]+", literal))


class Section:
    """One section of a code, from its tokens (kind, text): a shape of a letter a token, and the literals it shows."""

    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        shape, literals = [], []
        for kind, said in tokens:
            letter, literal = _bracket(said[1:-1]) if kind == "bracket" else (_LETTER[kind], {"quoted": said[1:-1], "escaped": said[1:], "mark": said}.get(kind, ""))
            if kind == "quoted" and not literal:
                continue
            below = "/" in shape or "0" not in shape or "." in shape
            if kind == "bar" and (below or shape[-1] != "0"):
                letter, literal = "/" if "/" in shape else "|", "/"
            shape.append(letter)
            literals.append(literal)
        self.shape = "".join(shape).replace("k", "").replace("|", "x")
        self.colour = "k" in shape
        self.literal = "".join("".join(literals).split())
        self.sign = any(map(_signed, literals))
        self.numbers = [int(said) for kind, said in tokens if kind == "number"]

    @property
    def sound(self) -> bool:
        return not _NO_SECTION.search(self.shape)

    @property
    def empty(self) -> bool:
        return not self.shape.replace("c", "")

    @property
    def date(self) -> bool:
        return "d" in self.shape and not (self.sound and "G" in self.shape)

    @property
    def scaling(self) -> int:
        """Commas after the last place, each a thousandth."""
        return self.shape.rpartition("0")[2].count(",")

    def too_small(self, size: float) -> bool:
        """Whether a magnitude shows no digit other than zero here."""
        percents = self.shape.count("%")
        if re.search(_BAR, self.shape):
            below = re.split(_BAR, self.shape)[1]
            steps = self.numbers[-1] if below.startswith("1") else 10 ** below.count("0") - 1
            return size * 100.0**percents * steps < 0.5
        decimals = self.shape.partition(".")[2].count("0") + 2 * percents - 3 * self.scaling
        return not set("EG") & set(self.shape) and shown_from(size) > decimals


class Code:
    """A format code's sections, and whether they make a code."""

    def __init__(self, code: str) -> None:
        tokens = [(m.lastgroup or "", m[0]) for m in _TOKEN.finditer(code)]
        whole = bool(code) and all(kind != "open" for kind, _ in tokens)
        cuts = [-1, *(i for i, (kind, _) in enumerate(tokens) if kind == "cut"), len(tokens)]
        self.sections = [Section(tokens[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False)] if whole else []
        shapes = [s.shape for s in self.sections]
        self.sound = whole and len(shapes) <= 4 and all(s.sound for s in self.sections) and sum("c" in x for x in shapes) <= 2
        self.sound = self.sound and not any("@" in x and (x is not shapes[-1] or "c" in x) for x in shapes) and (len(shapes) < 4 or "@" in shapes[3] or self.sections[3].empty)
        self.says = self.sections[-1] if self.sound and ("@" in shapes[-1] or len(shapes) == 4) else None
        self.numeric = self.sections[: len(shapes) - (self.says is not None)]


def shown_from(magnitude: float) -> int:
    """Fewest decimals at which a magnitude shows a digit other than zero."""
    return int(min(99, max(-99, math.ceil(math.log10(0.5 / magnitude)))))


def _by_section(code: Code, value: float) -> tuple[bool, bool]:
    """What the section that shows a number loses."""
    place = _SHOWS[len(code.numeric)][(value > 0) * 0 + (value == 0) * 1 + (value < 0) * 2]
    own = code.numeric[place]
    if value == 0 or (value < 0 and own.too_small(-value)):
        return False, False
    unmarked = own.colour and not (own.sign or own.empty) and own.literal == code.numeric[0].literal
    return own.empty, bool(re.search(_BAR, own.shape) and own.scaling) or (place == 1 and unmarked)


#: What is lost, by the first case that fits: a test of (id, code, value), and (hidden, misrendered).
_CASES = [
    (lambda i, c, v: c is None, lambda i, c, v: (False, v is not None and i in LOCALE_IDS)),
    (lambda i, c, v: not c.sound and v is None, lambda i, c, v: (len(c.sections) == 4, False)),
    (lambda i, c, v: not c.sound, lambda i, c, v: (False, any(s.date for s in c.sections))),
    (lambda i, c, v: v is None, lambda i, c, v: (c.says is not None and c.says.empty, False)),
    (lambda i, c, v: not c.numeric or any("c" in s.shape for s in c.sections), lambda i, c, v: (False, False)),
    (lambda i, c, v: True, lambda i, c, v: _by_section(c, v)),
]


def loss(format_id: int, code: str | None, value: float | None) -> tuple[bool, bool]:
    """(hidden, misrendered) of a number, or of text where value is None."""
    said = BUILTIN.get(format_id) if code is None else code
    given = (format_id, None if said is None else Code(said), value)
    return next(lost(*given) for fits, lost in _CASES if fits(*given))


def losses(cells: DataFrame, format_id: str = "format_id", code: str = "code", value: str = "value") -> DataFrame:
    """`cells` with hidden and misrendered; each different combination is parsed once."""
    from quillrow.session import ship

    ship(cells.sparkSession)

    @F.pandas_udf("hidden boolean, misrendered boolean")
    def judged(ids, codes, values):  # noqa: ANN001, ANN202
        import pandas as pd

        known: dict = {}
        rows = []
        for i, c, v in zip(ids, codes, values, strict=True):
            key = (int(i), c, None if pd.isna(v) else float(v))
            if key not in known:
                known[key] = loss(*key)
            rows.append(known[key])
        return pd.DataFrame(rows, columns=["hidden", "misrendered"])

    return cells.withColumn("loss_", judged(format_id, code, value)).withColumns({"hidden": F.col("loss_.hidden"), "misrendered": F.col("loss_.misrendered")}).drop("loss_")
