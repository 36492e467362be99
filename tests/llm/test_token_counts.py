import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.llm import token_counts

public = pytest.importorskip("public_tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
RULES = {"word_bpe_49k.json": "words", "byte_bpe_50k.json": "space kept", "piece_bpe_32k.model": "space dropped"}

ODD = [
    "", " ", "\n\n", "a", "don't we'll  stop", "x <|startoftext|> y<|endoftext|>z <|endoftext|>", "<|startoftext|", "12345 6.78,9", "é ́e á",
    "ΑΣ ΣΑΣ", "İstanbul", "日本語のテキスト。次の文、続く", "ab\x1ccd\x85ef gh ij", "a\tb\rc\x0bd\x0ce", "😀😀 👩‍👩‍👧", "a" * 3000, "word " * 3000, "1" * 3000, "a.b!c?" * 800,
]


def whole(name):
    """The library itself, one text at a time."""
    path = public.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return token_counts.Lengths(public.path(request.param), piece=20, batch_bytes=50), whole(request.param), request.param


def test_known_files_are_cut(both):
    assert both[0].rule == RULES[both[2]]


def test_odd_texts_count_as_the_library_counts_them(both):
    lengths, plain, _ = both
    assert lengths.count([*ODD, None]) == [plain(t) for t in ODD] + [0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eÉ'st.,19 \n\t\x1c  <|>日。éßΣ😀"), max_size=120), min_size=1, max_size=4))
def test_cut_texts_count_as_whole_ones(both, texts):
    lengths, plain, _ = both
    assert lengths.count(texts) == [plain(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=4))
def test_any_characters(both, texts):
    lengths, plain, _ = both
    assert lengths.count(texts) == [plain(t) for t in texts]


def test_pieces_are_bounded_and_put_together_the_text():
    text = "some words, and more " * 2000
    lengths = token_counts.Lengths(public.path("byte_bpe_50k.json"), piece=500)
    pieces = list(lengths.pieces(text))
    assert "".join(pieces) == text and max(map(len, pieces)) < 530
    lengths = token_counts.Lengths(public.path("word_bpe_49k.json"), piece=500)
    assert max(map(len, lengths.pieces("1" * 10_000))) <= 501 and "".join(lengths.pieces("1" * 10_000)) == "1" * 10_000


def test_remembered_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_WORDS", 10)
    lengths, plain = token_counts.Lengths(public.path("word_bpe_49k.json")), whole("word_bpe_49k.json")
    for k in range(20):
        text = " ".join(f"word{k}x{i}" for i in range(8)) + " " + "long" * 30
        assert lengths.count([text]) == [plain(text)]
        assert len(lengths.known) <= 18 and all(len(w) <= token_counts.KNOWN_LENGTH for w in lengths.known)


def test_unknown_kinds_are_encoded_whole():
    assert token_counts._rule({"pre_tokenizer": {"type": "Metaspace"}}) == "whole"
    assert token_counts._rule({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": [{"content": "x", "lstrip": True}]}) == "whole"


def test_rows_of_all_kinds(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts + ODD).withColumn("n_bytes", F.lit(-1)).withColumn("batch", F.lit("own"))
    docs = docs.union(docs.limit(4))
    rows = token_counts.with_token_counts(docs, public.path("word_bpe_49k.json"), limit=100).collect()
    plain = whole("word_bpe_49k.json")
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {*docs.columns, "n_tokens", "over_limit"}
    for r in rows:
        n = plain(r["text"] or "")
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"], r["batch"]) == (len((r["text"] or "").encode()), n, n > 100, "own")
    assert token_counts.with_token_counts(docs.limit(0), public.path("word_bpe_49k.json")).collect() == []


def test_query_against_the_library(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    plain = whole("word_bpe_49k.json")
    rows = token_counts.query_token_counts(spark, data).collect()
    assert len(rows) == len(texts) and os.path.exists(public.path("word_bpe_49k.json"))
    for r in rows:
        n = plain(texts[r["doc_id"]] or "")
        assert tuple(r) == (r["doc_id"], len((texts[r["doc_id"]] or "").encode()), n, n > 2048)
