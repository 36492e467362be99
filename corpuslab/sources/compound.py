"""Paragraphs of binary word-processor files: a compound file's streams, and the piece table that orders the text."""

from __future__ import annotations

import struct

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: beginning of a compound file, end of a chain, beginning of a document stream and places in it.
MAGIC, LAST, WORD = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFA, 0xA5EC
FLAGS_AT, LENGTH_AT, PIECES_AT = 0x0A, 0x4C, 0x1A2
ENCRYPTED, OTHER_TABLE, NARROW = 0x0100, 0x0200, 0x40000000


def _numbers(data: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))


def _chain(first: int, links: list[int]) -> list[int]:
    """Sectors of a chain; one that never ends is damage."""
    out = []
    while first < LAST:
        if first >= len(links) or len(out) > len(links):
            raise ValueError("damaged chain")
        out.append(first)
        first = links[first]
    return out


def streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name."""
    if content[:8] != MAGIC:
        raise ValueError("no compound file")
    size, small = (1 << k for k in struct.unpack_from("<HH", content, 0x1E))
    n_table, first_entry, _, limit, first_small, _, more, _ = struct.unpack_from("<8I", content, 0x2C)
    sector = lambda k: content[(k + 1) * size : (k + 2) * size]
    places = _numbers(content[0x4C:0x200])
    seen = 0
    while more < LAST and seen <= len(content) // size:
        block = _numbers(sector(more))
        places, more, seen = places + block[:-1], block[-1], seen + 1
    links = [x for k in places[:n_table] for x in _numbers(sector(k))]
    read = lambda first: b"".join(sector(k) for k in _chain(first, links))
    entries, found = read(first_entry), {}
    small_links, pool = _numbers(read(first_small)) if first_small < LAST else [], b""
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 0x40)
        first, n = struct.unpack_from("<II", entries, at + 0x74)
        if kind == 5:
            pool = read(first) if first < LAST else b""
        elif kind == 2:
            found[entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")] = (first, n)
    out = {}
    for name, (first, n) in found.items():
        data = read(first) if n >= limit else b"".join(pool[k * small : (k + 1) * small] for k in _chain(first, small_links)) if n else b""
        out[name] = data[:n]
    return out


def _piece_table(table: bytes) -> bytes:
    at = 0
    while at < len(table) and table[at] == 1:
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= len(table) or table[at] != 2:
        raise ValueError("no piece table")
    return table[at + 5 : at + 5 + struct.unpack_from("<I", table, at + 1)[0]]


def document_text(content: bytes) -> str:
    """The main text in its order, with the marks that end paragraphs and cells."""
    parts = streams(content)
    main = parts["WordDocument"]
    if struct.unpack_from("<H", main, 0)[0] != WORD:
        raise ValueError("no document")
    flags = struct.unpack_from("<H", main, FLAGS_AT)[0]
    if flags & ENCRYPTED:
        raise ValueError("encrypted")
    begin, size = struct.unpack_from("<II", main, PIECES_AT)
    pieces = _piece_table(parts["1Table" if flags & OTHER_TABLE else "0Table"][begin : begin + size])
    n = (len(pieces) - 4) // 12
    bounds, out = struct.unpack_from(f"<{n + 1}I", pieces, 0), []
    for k in range(n):
        place, chars = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)[0], bounds[k + 1] - bounds[k]
        if place & NARROW:
            place = (place & ~NARROW) // 2
            out.append(main[place : place + chars].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out)[: struct.unpack_from("<I", main, LENGTH_AT)[0]]


def paragraphs(content: bytes) -> list[str]:
    """Paragraphs with text; field codes and control characters go. A damaged, encrypted or other file has none."""
    try:
        text = document_text(content)
    except (ValueError, KeyError, IndexError, struct.error, UnicodeError, OverflowError, MemoryError):
        return []
    text = regex.sub("\x13[^\x13\x14\x15]*\x14?", "", text)
    lines = regex.split("[\r\x07\x0c]", text.replace("\x0b", "\n"))
    return [x for x in (regex.sub(r"[\x00-\x08\x0e-\x1f]", "", line).strip() for line in lines) if x]


def doc_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, para_no, text) of binary word-processor files."""

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: paragraphs(bytes(c)) if c is not None else [])

    lines: Column = F.pandas_udf(run, "array<string>")("content")
    return spark.read.format("binaryFile").load(path).select("path", F.posexplode(lines).alias("para_no", "text"))
