"""Binary documents, exports and the clipboard."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from corpuslab.sources import compound, export, readers


def compound_file(pieces, narrow_first=True, flags=0x0200):
    """A compound file with a document stream of some pieces (written in reverse order) and its piece table."""
    main, bounds, entries, at = bytearray(0x400), [0], [], {}
    for k in reversed(range(len(pieces))):
        narrow = narrow_first and k == 0 and all(ord(c) < 256 for c in pieces[k])
        at[k] = (len(main), narrow)
        main += pieces[k].encode("cp1252" if narrow else "utf-16-le")
    for k, p in enumerate(pieces):
        bounds.append(bounds[-1] + len(p))
        place, narrow = at[k]
        entries.append(struct.pack("<HIH", 0, place * 2 | 0x40000000 if narrow else place, 0))
    body = struct.pack(f"<{len(bounds)}I", *bounds) + b"".join(entries)
    table = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(body)) + body
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, flags)
    struct.pack_into("<I", main, 0x4C, bounds[-1])
    struct.pack_into("<II", main, 0x1A2, 0, len(table))
    parts = [bytes(main).ljust(4096, b"\0"), table.ljust(4096, b"\0")]
    counts = [-(-len(p) // 512) for p in parts]
    links, first, sectors = [0xFFFFFFFD, 0xFFFFFFFE], [], b""
    for p, n in zip(parts, counts, strict=True):
        first.append(len(links))
        links += [len(links) + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
        sectors += p.ljust(n * 512, b"\0")
    entry = lambda name, kind, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + bytes(0x74 - 0x43) + struct.pack("<II", start, size) + bytes(4)
    listed = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, first[0], len(parts[0])) + entry("1Table", 2, first[1], len(parts[1])) + bytes(128)
    head = compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head = head[:0x2C] + struct.pack("<8I", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack(f"<{len(links)}I", *links).ljust(512, b"\xff") + listed + sectors


def test_pieces_in_their_order():
    text = ["Plain caf\xe9.\r", "Вторая часть", " идёт дальше.\rЯчейка\x07Другая\x07\rПоле \x13 PAGE \x147\x15 стр.\r"]
    assert compound.paragraphs(compound_file(text)) == ["Plain café.", "Вторая часть идёт дальше.", "Ячейка", "Другая", "Поле 7 стр."]
    assert compound.paragraphs(compound_file(text, flags=0x0300)) == []


def test_damage_gives_nothing_and_never_fails():
    whole, rng = compound_file(["Текст документа.\r"]), random.Random(1234)
    assert compound.paragraphs(b"") == compound.paragraphs(b"PK") == []
    for _ in range(300):
        broken = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.5 else whole)
        for _ in range(rng.randrange(6)):
            if broken:
                broken[rng.randrange(len(broken))] = rng.randrange(256)
        assert isinstance(compound.paragraphs(bytes(broken)), list)


def test_doc_files(spark, tmp_path):
    (tmp_path / "a.doc").write_bytes(compound_file(["Один.\rДва.\r"]))
    (tmp_path / "b.doc").write_bytes(b"nothing")
    assert [(r["para_no"], r["text"]) for r in compound.doc_files(spark, str(tmp_path)).collect()] == [(0, "Один."), (1, "Два.")]


def test_exports_are_read_again(spark):
    own = ["Первый <абзац> & «знак»", "", "  second  ", "with\x01control"]
    df = spark.createDataFrame([(own,), (None,)], "p array<string>")
    for kind in ("docx", "odt"):
        first, second = (r[0] for r in df.select(export.exported(F.col("p"), kind)).collect())
        assert [p["text"] for p in readers.office_paragraphs(bytes(first))] == [*own[:3], "withcontrol"] and second is None
    assert bytes(df.select(export.exported(F.col("p"), "txt")).first()[0]).decode() == "\n".join([*own[:3], "withcontrol"])
    assert b"&lt;" in bytes(df.select(export.exported(F.col("p"), "html")).first()[0])
    with pytest.raises(ValueError):
        export.exported(F.col("p"), "pdf")


def test_clipboard(spark):
    rows = [("<p>One</p><script>x()</script><p>two <b>three</b><img src=x></p>", "plain"), ("", "a\r\n\r\n b  c"), (None, None)]
    df = spark.createDataFrame(rows, "h string, t string")
    got = [r[0] for r in df.select(export.from_clipboard(F.col("h"), F.col("t"))).collect()]
    assert got == [["One", "two three"], ["a", "b c"], []]
    assert spark.createDataFrame([(["a<b", "c"],)], "p array<string>").select(export.clipboard_html(F.col("p"))).first()[0] == "<p>a&lt;b</p><p>c</p>"
