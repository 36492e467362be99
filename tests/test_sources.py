import bz2
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuslab.sources import readers, sinks


def test_json_lines_skip_blank_lines_and_fill_optional_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"src": "x", "gold": "y", "comma": ["KEEP"], "form": ["KEEP"]}\n\n{"src": "p", "gold": "q"}\n')
    labelled, raw = readers.labelled_pairs(spark, str(tmp_path / "a.jsonl"))
    assert labelled.count() == 1 and [tuple(r) for r in raw.collect()] == [("p", "q")]


def test_sentences_by_document(spark, tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps({"d1": ["one", "two"], "d2": []}))
    rows = readers.sentences_by_document(spark, str(tmp_path / "docs.json"))
    assert [tuple(r) for r in rows.orderBy("sent_no").collect()] == [("d1", 0, "one"), ("d1", 1, "two")]


def test_xml_dump_bz2(spark, tmp_path):
    page = lambda t, ns, extra="": f"<page><title>{t}</title><ns>{ns}</ns>{extra}<revision><text>body {t}</text></revision></page>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>{page('A', 0)}{page('B', 1)}{page('C', 0, '<redirect>x</redirect>')}</mediawiki>".encode()))
    assert [tuple(r) for r in readers.xml_pages(spark, str(tmp_path / "dump.xml.bz2")).collect()] == [("A", "body A")]


def test_text_files_in_several_encodings(spark, tmp_path):
    samples = {"a.txt": "один".encode(), "b.txt": "один".encode("cp1251"), "c.txt": "один".encode("utf-16"), "d.txt": b"\xef\xbb\xbf" + "один".encode(), "e.txt": b"a\0b"}
    for name, content in samples.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["path"][-5:]: (r["text"], r["encoding"]) for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("один", "utf-8"), "b.txt": ("один", "cp1251"), "c.txt": ("один", "utf-16"), "d.txt": ("один", "utf-8-sig"), "e.txt": (None, None)}


def package(name, content):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, content)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t><w:tab/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
ODT = '<o:c xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h>Top</text:h><text:p>a<text:s text:c="2"/>b<text:tab/>c</text:p></o:c>'


def test_office_packages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package("word/document.xml", DOCX))
    (tmp_path / "b.odt").write_bytes(package("content.xml", ODT))
    rows = [tuple(r)[1:] for r in readers.office_files(spark, str(tmp_path)).orderBy("path", "para_no").collect()]
    assert rows == [(0, "Top", "Heading1", False), (1, "cell\t", "", True), (0, "Top", "heading", False), (1, "a  b\tc", "", False)]


def test_damaged_packages_give_nothing():
    import random

    rng, whole = random.Random(1234), package("word/document.xml", DOCX)
    for _ in range(200):
        data = bytearray(whole[: rng.randint(0, len(whole))])
        for _ in range(rng.randint(0, 4)):
            if data:
                data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            assert isinstance(readers.office_paragraphs(bytes(data)), list)
        except Exception as e:  # zlib and zip errors are named in the reader
            pytest.fail(f"{type(e).__name__}: {e}")


def test_dispatch(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.open_any(spark, "x.exe")


def test_frequency_list_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "word string, n bigint")
    sinks.frequency_list(vocab.coalesce(1), str(tmp_path / "v"))
    assert sorted(map(tuple, readers.frequency_list(spark, str(tmp_path / "v")).collect())) == [("a", 2), ("b", 2), ("c", 5)]


def test_chunks_resume(spark, tmp_path):
    df = spark.range(10).withColumn("chunk", (F.col("id") % 2).cast("int"))
    sinks.chunks(df.where("chunk = 0"), str(tmp_path / "c"), "chunk")
    sinks.chunks(df, str(tmp_path / "c"), "chunk")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 10


def test_cache_fill_computes_only_what_is_missing(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.withColumn("out", F.upper("src"))

    a = spark.createDataFrame([("x",), ("y",), ("x",)], "src string")
    sinks.cache_fill(a, "src", str(tmp_path / "p"), compute)
    out = sinks.cache_fill(a.union(spark.createDataFrame([("z",)], "src string")), "src", str(tmp_path / "p"), compute)
    assert seen == [2, 1] and out.count() == 3


def test_html_paragraphs(spark):
    df = spark.createDataFrame([(1, "<p>One &amp; two<br>three</p><script>no</script><div> four  <b>five</b></div>"), (2, None)], "id int, html string")
    assert [r["par"] for r in readers.html_paragraphs(df).orderBy("para_no").collect()] == ["One & two", "three", "four five"]
