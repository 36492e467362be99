"""Corrected copies of files: replacements in original coordinates change only the characters that they name.

Files travel as binary columns, so that copies are made where the data is. A file never overwrites its source: the
content comes back as a new column, and the caller writes it.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.sources.readers import _TEXT, _W, decode

REPLACEMENTS = "array<struct<paragraph:int,start:int,end:int,text:string>>"


def spliced(text: str, replacements: Iterable[dict]) -> str:
    """Replacements of one paragraph applied from right to left."""
    for r in sorted(replacements, key=lambda r: (r["start"], r["end"]), reverse=True):
        text = text[: r["start"]] + (r["text"] or "") + text[r["end"] :]
    return text


def spread(pieces: list[str], replacements: Iterable[dict]) -> list[str]:
    """The same over a paragraph cut into pieces (runs): new text goes to the piece where its place begins."""
    starts, at = [], 0
    for p in pieces:
        starts.append(at)
        at += len(p)
    out = list(pieces)
    for r in sorted(replacements, key=lambda r: (r["start"], r["end"]), reverse=True):
        new = r["text"] or ""
        hit = [k for k, p in enumerate(pieces) if starts[k] < r["end"] and r["start"] < starts[k] + len(p)]
        if not hit:  # an insertion, or a place at a border: the piece that ends there
            hit = [max((k for k in range(len(pieces)) if starts[k] < r["start"] or (starts[k] == 0 and r["start"] == 0)), default=0)] if pieces else []
        for n, k in enumerate(hit):
            a, b = max(0, r["start"] - starts[k]), min(len(pieces[k]), max(r["start"], r["end"]) - starts[k])
            out[k] = out[k][:a] + (new if n == 0 else "") + out[k][b:]
    return out


def _by_paragraph(replacements: Iterable[dict]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in replacements:
        out.setdefault(r["paragraph"], []).append(r)
    return out


def patch_text(content: bytes, replacements: Iterable[dict]) -> bytes | None:
    """Paragraphs are lines; the encoding, its mark and each line's end stay. None if the text or the new letters cannot be coded."""
    text, encoding = decode(content)
    if text is None:
        return None
    by, lines = _by_paragraph(replacements), text.splitlines(keepends=True)
    for k, line in enumerate(lines):
        body = line.rstrip("\r\n")
        lines[k] = spliced(body, by.get(k, [])) + line[len(body) :]
    try:
        whole = "".join(lines)
        if encoding == "utf-16":
            big = content.startswith(b"\xfe\xff")
            return content[:2] + whole.encode("utf-16-be" if big else "utf-16-le")
        return whole.encode(encoding)
    except UnicodeEncodeError:
        return None


def _text_slots(root: ElementTree.Element) -> list[list[tuple[ElementTree.Element, str]]]:
    """Of each paragraph, in reading order, the (element, attribute) that hold its text; fixed characters have None as element."""
    out: list[list[tuple]] = []

    def docx(node: ElementTree.Element, slots: list) -> None:
        for child in node:
            if child.tag == _W + "del":
                continue
            if child.tag == _W + "t":
                slots.append((child, "text"))
            elif child.tag == _W + "tab" or child.tag in (_W + "br", _W + "cr"):
                slots.append((None, "x"))
            else:
                docx(child, slots)

    def odt(node: ElementTree.Element, slots: list) -> None:
        slots.append((node, "text"))
        for child in node:
            name = child.tag.rsplit("}", 1)[-1]
            if name in ("tab", "line-break", "s"):
                slots += [(None, "x")] * (int(child.get(_TEXT + "c", 1)) if name == "s" else 1)
            else:
                odt(child, slots)
            slots.append((child, "tail"))

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            if child.tag == _W + "p":
                out.append([])
                docx(child, out[-1])
            elif child.tag in (_TEXT + "p", _TEXT + "h"):
                out.append([])
                odt(child, out[-1])
            elif child.tag not in (_W + "del", _TEXT + "tracked-changes"):
                walk(child)

    walk(root)
    return out


def patch_office(content: bytes, replacements: Iterable[dict]) -> bytes | None:
    """A DOCX or ODT package with changed text; every other part keeps its bytes, order and compression. None if it is damaged."""
    by, out = _by_paragraph(replacements), io.BytesIO()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
            names = set(old.namelist())
            target = "word/document.xml" if "word/document.xml" in names else "content.xml"
            for info in old.infolist():
                data = old.read(info)
                if info.filename == target:
                    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(data), ["start-ns"]):
                        ElementTree.register_namespace(prefix, uri)
                    root = ElementTree.fromstring(data)
                    for k, slots in enumerate(_text_slots(root)):
                        if k in by:
                            pieces = ["x" if e is None else (getattr(e, name) or "") for e, name in slots]
                            for (e, name), piece in zip(slots, spread(pieces, by[k]), strict=True):
                                if e is not None:
                                    setattr(e, name, piece)
                                    if e.tag == _W + "t" and piece != piece.strip():
                                        e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                    data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
                new.writestr(info, data, compress_type=info.compress_type)
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, KeyError, ValueError, OSError, NotImplementedError):
        return None
    return out.getvalue()


PATCHERS = {".txt": patch_text, ".docx": patch_office, ".odt": patch_office}


def patched(path: Column | str, content: Column | str, replacements: Column | str) -> Column:
    """The corrected copy (binary) by the file's extension; null for unknown extensions and damaged files."""

    def run(paths: pd.Series, contents: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for p, c, r in zip(paths, contents, lists, strict=True):
            patch = PATCHERS.get("." + p.rsplit(".", 1)[-1].lower())
            out.append(patch(bytes(c), list(r) if r is not None else []) if patch and c is not None else None)
        return pd.Series(out)

    return F.pandas_udf(run, "binary")(path, content, replacements)
