"""Office and book packages as Markdown: every outcome is a row, with an error code where a package is refused.

A package is read with the standard library alone. What can't be shown faithfully refuses the whole
package (`incomplete_conversion`); what is left out on purpose is disclosed by a warning.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.operators import numberformats
from quillrow.sources.tabular import escaped

# Bytes of all members together, and how often larger than the package they may be.
MOST_EXPANDED, MOST_RATIO = 256 << 20, 200
# Media type of a package's first member, and the kind that it names.
MIMETYPES = {"application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp"}


class Refused(Exception):
    """A package that isn't converted; the message is its code."""


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ET.Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def tree(z: zipfile.ZipFile, name: str) -> ET.Element:
    try:
        return ET.fromstring(z.read(name))
    except KeyError as e:
        raise Refused("incomplete_conversion") from e
    except ET.ParseError as e:
        raise Refused("malformed") from e


def relations(z: zipfile.ZipFile, part: str) -> tuple[dict[str, str], bool]:
    """Targets of a part's relationships by id, and whether some lead outside of the package."""
    head, tail = posixpath.split(part)
    name = f"{head}/_rels/{tail}.rels"
    if name not in z.namelist():
        return {}, False
    out, outside = {}, False
    for r in tree(z, name):
        if r.get("TargetMode") == "External":
            outside = True
        else:
            target = r.get("Target", "")
            out[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(head, target))
    return out, outside


def kind_of(z: zipfile.ZipFile) -> str:
    """Kind of a package by its parts; encryption is looked for first, then active content."""
    names = set(z.namelist())
    if names & {"EncryptedPackage", "EncryptionInfo"} or any(i.flag_bits & 1 for i in z.infolist()) or "META-INF/encryption.xml" in names:
        raise Refused("encrypted")
    total = sum(i.file_size for i in z.infolist())
    if total > MOST_EXPANDED or total > MOST_RATIO * max(1, sum(i.compress_size for i in z.infolist())) and total > 1 << 20:
        raise Refused("resource_limit")
    if any(re.search(r"vbaproject\.bin$|^basic/|^scripts/|activex/", n, re.I) for n in names):
        raise Refused("active_content_disabled")
    for kind, main in (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml")):
        if main in names:
            return kind
    if "mimetype" in names:
        kind = MIMETYPES.get(z.read("mimetype").decode("ascii", "replace").strip())
        if kind:
            return kind
    raise Refused("unrecognized")


def pipe_table(rows: list[list[str]]) -> list[str]:
    """Lines of a pipe table, short rows filled up."""
    width = max(map(len, rows), default=0)
    full = [[escaped(c) for c in r] + [""] * (width - len(r)) for r in rows]
    return ["| " + " | ".join(r) + " |" for r in full[:1]] + ["|" + "---|" * width] + ["| " + " | ".join(r) + " |" for r in full[1:]] if width else []


def docx(z: zipfile.ZipFile, warnings: set[str]) -> str:
    body = tree(z, "word/document.xml").find("{*}body")
    if body is None:
        raise Refused("malformed")
    if relations(z, "word/document.xml")[1]:
        warnings.add("external_relationships_blocked")

    def said(p: ET.Element) -> str:
        out = []
        for run in p.iter():
            name = local(run.tag)
            if name == "vanish" and attribute(run, "val") not in ("0", "false"):
                warnings.add("hidden_content_preserved")
            elif name == "t":
                out.append(run.text or "")
            elif name in ("tab", "br"):
                out.append(" ")
            elif name in ("txbxContent", "object"):
                raise Refused("incomplete_conversion")
        return "".join(out).strip()

    lines: list[str] = []
    for e in body:
        name = local(e.tag)
        if name == "p":
            style = e.find("{*}pPr/{*}pStyle")
            level = re.fullmatch(r"heading\s?([1-6])", (attribute(style, "val") or "") if style is not None else "", re.I)
            text = said(e)
            item = "- " if e.find("{*}pPr/{*}numPr") is not None else ""
            if text:
                lines += [("#" * int(level[1]) + " " if level else item) + text, ""]
        elif name == "tbl":
            lines += [*pipe_table([[said(c) for c in r.findall("{*}tc")] for r in e.findall("{*}tr")]), ""]
    return "\n".join(lines).strip() + "\n"


def xlsx(z: zipfile.ZipFile, warnings: set[str]) -> str:
    targets = relations(z, "xl/workbook.xml")[0]
    shared = ["".join(t.text or "" for t in s.iter() if local(t.tag) == "t") for s in tree(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    formats: list[tuple[int, str | None]] = []
    if "xl/styles.xml" in z.namelist():
        style = tree(z, "xl/styles.xml")
        codes = {int(f.get("numFmtId", 0)): f.get("formatCode") for f in style.iter() if local(f.tag) == "numFmt"}
        held = style.find("{*}cellXfs")
        formats = [(int(x.get("numFmtId", 0)), codes.get(int(x.get("numFmtId", 0)))) for x in (held if held is not None else ())]
    out: list[str] = []
    for sheet in tree(z, "xl/workbook.xml").iter():
        if local(sheet.tag) != "sheet":
            continue
        if sheet.get("state", "visible") != "visible":
            raise Refused("incomplete_conversion")
        part = targets.get(attribute(sheet, "id") or "")
        if part is None:
            raise Refused("incomplete_conversion")
        rows: list[list[str]] = []
        for row in tree(z, part).iter():
            if local(row.tag) != "row":
                continue
            cells: list[str] = []
            for c in row:
                kind, value = c.get("t", "n"), c.find("{*}v")
                column = 0
                for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (column - 1 - len(cells))
                if c.find("{*}f") is not None and (value is None or not value.text):
                    raise Refused("incomplete_conversion")  # a formula without a value to show
                said = value.text or "" if value is not None else ""
                number = None
                if kind == "s":
                    said = shared[int(said)]
                elif kind == "inlineStr":
                    said = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
                elif said and kind == "n":
                    number = float(said)
                if said and c.get("s") and int(c.get("s")) < len(formats) and any(numberformats.loss(*formats[int(c.get("s"))], number)):
                    raise Refused("incomplete_conversion")
                cells.append(said)
            if any(cells):
                rows.append(cells)
        out += [f"## {escaped(sheet.get('name', ''))}", "", *pipe_table(rows), ""]
    return "\n".join(out).strip() + "\n"


def pptx(z: zipfile.ZipFile, warnings: set[str]) -> str:
    targets = relations(z, "ppt/presentation.xml")[0]
    out: list[str] = []
    listed = [e for e in tree(z, "ppt/presentation.xml").iter() if local(e.tag) == "sldId" and attribute(e, "id")]
    for n, e in enumerate(listed, 1):
        part = targets.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), ""))
        if part is None or part not in z.namelist():
            raise Refused("incomplete_conversion")
        slide = tree(z, part)
        if slide.get("show") in ("0", "false"):
            raise Refused("incomplete_conversion")
        out += [f"## Slide {n}", ""]
        for p in slide.iter():
            if local(p.tag) == "p" and (text := "".join(t.text or "" for t in p.iter() if local(t.tag) == "t").strip()):
                out += [text, ""]
    return "\n".join(out).strip() + "\n"


def opendocument(z: zipfile.ZipFile, warnings: set[str]) -> str:
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        name = local(e.tag)
        if name == "table":
            rows = []
            for r in e.iter():
                if local(r.tag) == "table-row":
                    cells = []
                    for c in r:
                        times = int(attribute(c, "number-columns-repeated") or 1)
                        text = " ".join("".join(p.itertext()).strip() for p in c if local(p.tag) == "p")
                        if attribute(c, "formula") and not text:
                            raise Refused("incomplete_conversion")
                        if times > 16384 or (text and times > 4096):
                            raise Refused("resource_limit")
                        cells += [text] * (times if text else min(times, 1))
                    if any(cells):
                        rows.append(cells)
            out.extend([*pipe_table(rows), ""])
        elif name == "h":
            out.extend(["#" * min(6, int(attribute(e, "outline-level") or 1)) + " " + "".join(e.itertext()).strip(), ""])
        elif name == "p":
            if text := "".join(e.itertext()).strip():
                out.extend([text, ""])
        else:
            if name == "section" and attribute(e, "display") == "none":
                raise Refused("incomplete_conversion")
            for c in e:
                walk(c)

    body = tree(z, "content.xml").find("{*}body")
    if body is None:
        raise Refused("malformed")
    walk(body)
    return "\n".join(out).strip() + "\n"


def epub(z: zipfile.ZipFile, warnings: set[str]) -> str:
    root = next((e for e in tree(z, "META-INF/container.xml").iter() if local(e.tag) == "rootfile"), None)
    if root is None:
        raise Refused("malformed")
    at = root.get("full-path", "")
    package = tree(z, at)
    items = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(at), e.get("href", ""))) for e in package.iter() if local(e.tag) == "item"}
    out: list[str] = []
    for ref in (e for e in package.iter() if local(e.tag) == "itemref"):
        part = items.get(ref.get("idref"))
        if part is None or part not in z.namelist():
            raise Refused("incomplete_conversion")
        page = tree(z, part)
        for e in page.iter():
            name = local(e.tag)
            if name in ("script", "iframe", "object"):
                raise Refused("active_content_disabled")
            if src := (e.get("src") if name == "img" else None):
                if re.match("[a-z]+:", src):
                    warnings.add("remote_asset_removed")
                elif posixpath.normpath(posixpath.join(posixpath.dirname(part), src)) not in z.namelist():
                    raise Refused("incomplete_conversion")
            if level := re.fullmatch("h([1-6])", name):
                out += ["#" * int(level[1]) + " " + " ".join("".join(e.itertext()).split()), ""]
            elif name in ("p", "li") and (text := " ".join("".join(e.itertext()).split())):
                out += [("- " if name == "li" else "") + text, ""]
    return "\n".join(out).strip() + "\n"


LANES = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": opendocument, "ods": opendocument, "odp": opendocument, "epub": epub}


def convert(data: bytes) -> dict:
    """kind, completeness, markdown, warnings and error of one package."""
    kind, warnings = None, set()
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            kind = kind_of(z)
            text = LANES[kind](z, warnings)
        partial = warnings & {"characters_omitted", "list_numbering_differs"}
        return {"kind": kind, "completeness": "partial" if partial else "complete", "markdown": text, "warnings": sorted(warnings), "error": None}
    except Refused as e:
        code = str(e)
    except (zipfile.BadZipFile, ValueError, IndexError, NotImplementedError):
        code = "malformed"
    return {"kind": kind, "completeness": None, "markdown": None, "warnings": [], "error": code}


def converted(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with kind, completeness, markdown, warnings and error of their packages."""
    from quillrow.session import ship

    ship(files.sparkSession)

    @F.pandas_udf("kind string, completeness string, markdown string, warnings array<string>, error string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in parts:
            yield pd.DataFrame([convert(bytes(b or b"")) for b in column], columns=["kind", "completeness", "markdown", "warnings", "error"])

    names = ["kind", "completeness", "markdown", "warnings", "error"]
    return files.withColumn("package_", read(content)).withColumns({n: F.col(f"package_.{n}") for n in names}).drop("package_")
