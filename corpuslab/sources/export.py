"""Documents from paragraphs: TXT, HTML, DOCX and ODT as binary columns; and paragraphs from the clipboard."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions import cleaning as C
from corpuslab.functions import text as T
from corpuslab.sources.readers import BLOCK_END

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Parts and names of the package formats.
_WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DOC_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
_DOC_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/"
_ODF = "urn:oasis:names:tc:opendocument:xmlns:"
_ODT_TYPE = "application/vnd.oasis.opendocument.text"


def _packed(parts: list[tuple[str, str, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, body, how in parts:
            entry = zipfile.ZipInfo(name)  # a fixed date: the same paragraphs give the same bytes
            entry.compress_type = how
            package.writestr(entry, body)
    return out.getvalue()


def _docx(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    types = f'{_HEAD}<Types xmlns="{_PACKAGE}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{_DOC_TYPE}"/></Types>'
    links = f'{_HEAD}<Relationships xmlns="{_PACKAGE}relationships"><Relationship Id="rId1" Type="{_DOC_LINK}" Target="word/document.xml"/></Relationships>'
    text = f'{_HEAD}<w:document xmlns:w="{_WORD_NS}"><w:body>{body}</w:body></w:document>'
    return _packed([("[Content_Types].xml", types, zipfile.ZIP_DEFLATED), ("_rels/.rels", links, zipfile.ZIP_DEFLATED), ("word/document.xml", text, zipfile.ZIP_DEFLATED)])


def _odt(paragraphs: list[str]) -> bytes:
    body = "".join(f"<text:p>{escape(p)}</text:p>" for p in paragraphs)
    text = f'{_HEAD}<office:document-content xmlns:office="{_ODF}office:1.0" xmlns:text="{_ODF}text:1.0" office:version="1.2"><office:body><office:text>{body}</office:text></office:body></office:document-content>'
    listed = f'{_HEAD}<manifest:manifest xmlns:manifest="{_ODF}manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{_ODT_TYPE}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _packed([("mimetype", _ODT_TYPE, zipfile.ZIP_STORED), ("content.xml", text, zipfile.ZIP_DEFLATED), ("META-INF/manifest.xml", listed, zipfile.ZIP_DEFLATED)])


FORMATS = {
    "txt": lambda ps: "\n".join(ps).encode(),
    "html": lambda ps: ("<html><body>" + "".join(f"<p>{escape(p)}</p>" for p in ps) + "</body></html>").encode(),
    "docx": _docx,
    "odt": _odt,
}


def exported(paragraphs: Column | str, kind: str) -> Column:
    """A document of the paragraphs as bytes; unknown formats are refused, characters that XML forbids go."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    bare = F.transform(paragraphs, lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ps: None if ps is None else FORMATS[kind](list(ps)))

    return F.pandas_udf(run, "binary")(bare)


def clipboard_html(paragraphs: Column) -> Column:
    """Paragraphs as a fragment for the clipboard."""
    return F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), T.escape_html(p), F.lit("</p>"))), "")


def from_clipboard(html: Column, text: Column) -> Column:
    """Paragraphs of what was pasted: of the HTML without scripts and images, if there is any, else of the plain text."""
    lines = F.split(T.strip_markup(F.regexp_replace(C.without_unsafe(html), BLOCK_END, "\n")), "\n")
    plain = F.split(text, r"\r?\n")
    tidy = lambda a: F.filter(F.transform(a, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.coalesce(F.when(F.trim(html) != "", tidy(lines)), tidy(plain), F.array().cast("array<string>"))
