"""Sources: driver tables, JSON lines, frequency lists, XML dumps, text folders, HTML pages, binary documents."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.sources.compound import doc_files

PAIR = "doc string, src string, gold string, source string, domain string"
LABELLED = "src string, gold string, comma array<string>, form array<string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, optional keys become nulls."""
    return spark.read.schema(schema).json(paths)


def labelled_pairs(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of pairs that have labels, and those that still need them."""
    rows = json_lines(spark, paths, LABELLED)
    return rows.where("comma is not null"), rows.where("comma is null").select("src", "gold")


def sentences_by_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists (document -> sentences) as rows (doc, sent_no, sentence)."""
    rows = spark.read.schema("value string").text(path, wholetext=True)
    docs = rows.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("doc", "list"))
    return docs.select("doc", F.posexplode("list").alias("sent_no", "sentence"))


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (word, n)."""
    return spark.read.csv(path, sep="\t", schema="word string, n bigint", quote="")


def csv_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def xml_pages(spark: SparkSession, path: str, row_tag: str = "page", schema: str = "title string, ns int, redirect string, revision struct<text:string>") -> DataFrame:
    """Pages of an XML dump (also .bz2), namespace 0, without redirects; the filter runs before any text is parsed."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.where("ns = 0 and redirect is null").select("title", F.col("revision.text").alias("text"))


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; a byte order mark is dropped, files are read whole."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return rows.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")


BLOCK_END = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|br|title|body|head|html)\b[^>]*>"


def html_paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Visible paragraphs of pages: block tags end a paragraph, other markup goes; (para_no, par) beside the other columns."""
    keep = [c for c in pages.columns if c != html]
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|title)\b.*?</(?:script|style|title)>", " "), r"(?s)<!--.*?-->", " ")
    lines = F.split(T.strip_markup(F.regexp_replace(visible, BLOCK_END, "\n")), "\n")
    tidy = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.select(*keep, F.posexplode(tidy).alias("para_no", "par"))


def decode(content: bytes) -> tuple[str | None, str | None]:
    """Text and encoding of a plain text file: byte order marks, strict UTF-8, then windows-1251; zero bytes are no text."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            try:
                return content.decode(name), name
            except UnicodeDecodeError:
                return None, None
    if b"\0" in content:
        return None, None
    for name in ("utf-8", "cp1251"):
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return None, None


def decoded(content: Column | str) -> Column:
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(c)) if c is not None else (None, None) for c in contents], columns=["text", "encoding"])

    return F.pandas_udf(run, "struct<text:string,encoding:string>")(content)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of text files in unknown encodings; undecodable ones have nulls."""
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("d")).select("path", "d.*")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _docx(root: ElementTree.Element) -> list[tuple[str, str, bool]]:
    """(text, style, in a table) of every paragraph; tracked deletions are skipped."""
    out: list[tuple[str, str, bool]] = []

    def walk(node: ElementTree.Element, table: bool) -> None:
        for child in node:
            if child.tag == _W + "p":
                style = child.find(f"{_W}pPr/{_W}pStyle")
                parts: list[str] = []
                spell(child, parts)
                out.append(("".join(parts), style.get(_W + "val", "") if style is not None else "", table))
            elif child.tag != _W + "del":
                walk(child, table or child.tag == _W + "tbl")

    def spell(node: ElementTree.Element, parts: list[str]) -> None:
        for child in node:
            if child.tag == _W + "del":
                continue
            if child.tag == _W + "t":
                parts.append(child.text or "")
            elif child.tag == _W + "tab":
                parts.append("\t")
            elif child.tag in (_W + "br", _W + "cr"):
                parts.append("\n")
            else:
                spell(child, parts)

    walk(root, False)
    return out


def _odt(root: ElementTree.Element) -> list[tuple[str, str, bool]]:
    out: list[tuple[str, str, bool]] = []

    def walk(node: ElementTree.Element, table: bool) -> None:
        for child in node:
            if child.tag in (_TEXT + "p", _TEXT + "h"):
                out.append((spell(child), "heading" if child.tag == _TEXT + "h" else "", table))
            elif child.tag != _TEXT + "tracked-changes":
                walk(child, table or child.tag.endswith("}table"))

    def spell(node: ElementTree.Element) -> str:
        parts = [node.text or ""]
        for child in node:
            name = child.tag.rsplit("}", 1)[-1]
            parts.append({"tab": "\t", "line-break": "\n"}.get(name) or (" " * int(child.get(_TEXT + "c", 1)) if name == "s" else spell(child)))
            parts.append(child.tail or "")
        return "".join(parts)

    walk(root, False)
    return out


def office_paragraphs(content: bytes) -> list[dict]:
    """Paragraphs of a DOCX or ODT package; a damaged one has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            names = set(package.namelist())
            if "word/document.xml" in names:
                rows = _docx(ElementTree.fromstring(package.read("word/document.xml")))
            elif "content.xml" in names:
                rows = _odt(ElementTree.fromstring(package.read("content.xml")))
            else:
                return []
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, KeyError, ValueError, OSError, NotImplementedError):
        return []
    return [{"text": t, "style": s, "in_table": b} for t, s, b in rows]


def _office(content: Column | str) -> Column:
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: office_paragraphs(bytes(c)) if c is not None else [])

    return F.pandas_udf(run, "array<struct<text:string,style:string,in_table:boolean>>")(content)


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, para_no, text, style, in_table) of DOCX and ODT files."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.posexplode(_office("content")).alias("para_no", "p"))
    return rows.select("path", "para_no", "p.*")


READERS = {".txt": text_files, ".docx": office_files, ".odt": office_files, ".doc": doc_files, ".jsonl": lambda s, p: json_lines(s, p, PAIR), ".tsv": frequency_list, ".parquet": lambda s, p: s.read.parquet(p)}


def open_any(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension; an unknown one is refused."""
    ending = re.search(r"\.\w+$", path)
    if not ending or ending[0].lower() not in READERS:
        raise ValueError(f"no reader for {path!r}; known: {', '.join(sorted(READERS))}")
    return READERS[ending[0].lower()](spark, path)


def numbered(spark: SparkSession, folder: str, name: str, first: int = 1) -> DataFrame | None:
    """JSON lines of numbered batch files (``name`` has the place of the number, as in ``batch{}.jsonl``) up to the first gap,
    with ``batch``; None if there is no first one."""
    paths, k = [], first
    files = spark._jvm.org.apache.hadoop.fs
    while True:
        path = files.Path(f"{folder}/{name.format(k)}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            break
        paths.append(str(path))
        k += 1
    if not paths:
        return None
    head, tail = (re.escape(x) for x in name.split("{}"))
    return spark.read.json(paths).withColumn("batch", F.regexp_extract(F.input_file_name(), rf"{head}(\d+){tail}$", 1).cast("int"))


def evaluation_keys(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Distinct match keys of several columns of several tables, blank ones left out."""
    out = None
    for frame in frames:
        for c in columns:
            if c in frame.columns:
                part = frame.select(T.match_key(F.col(c)).alias("key"))
                out = part if out is None else out.union(part)
    return out.where("key <> ''").distinct()


def json_field(column: Column | str, name: str) -> Column:
    return F.get_json_object(column, f"$.{name}")


def benchmark_items(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Items of a public benchmark, one file of JSON lines a split: (split, doc, src, gold, raw, disputed); nothing is disputed."""
    out = None
    for split, path in paths.items():
        rows = json_lines(spark, path, "src string, gold string, doc string")
        part = rows.select(F.lit(split).alias("split"), "doc", "src", "gold", F.col("src").alias("raw"), F.array().cast("array<string>").alias("disputed"))
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no files of a benchmark")
    return out


#: Forms of a document that can be edited come before those that only show it.
EDITABLE = ["docx", "odt", "doc", "txt", "html", "pdf"]


def editable_first(files: DataFrame, key: str, path: str) -> DataFrame:
    """One file a document (``key``): the one that can best be edited, by its extension; ties by the path. Others are left out."""
    place = F.array_position(F.array(*[F.lit(x) for x in EDITABLE]), F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))
    rows = files.withColumn("_place", place).where("_place > 0")
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in files.columns if c != key]), F.struct("_place", path)).alias("_f")).select(key, "_f.*")


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """(n_files, n_bytes) of all files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
