import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import queries, spelling
from tests.compare import assert_same


def near(a, b):
    """Distance exactly one, by its definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=10):
    """Every pair of words compared, roots followed one form at a time."""
    out, forms = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            forms[w] = best
        out[w] = (forms.get(w), n, len(others), counts[forms[w]] if w in forms else None)
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé😀", max_size=6), min_size=1, max_size=8))
def test_keys_are_equal_exactly_for_equal_deletions(words):
    expected = []
    for k, w in enumerate(words):
        places = {}
        for i in range(len(w)):
            places.setdefault(w[:i] + w[i + 1 :], []).append(i)
        expected += [(k, w, -1, -1)] + [(k, d, min(p), max(p)) for d, p in places.items()]
    got = list(zip(*(x.tolist() for x in spelling.deletion_keys(words)), strict=True))
    assert sorted(x[1:] for x in got) == sorted((k, low, high) for k, _, low, high in expected)
    string = {(k, low): d for k, d, low, _ in expected}
    assert len({key for key, *_ in got}) == len({string[k, low] for _, k, low, _ in got}) == len({(key, string[k, low]) for key, k, low, _ in got})


def test_a_very_long_word_costs_its_length():
    rng = random.Random(1)
    word = "".join(rng.choice("abc") for _ in range(300_000))
    key, _, low, high = spelling.deletion_keys([word, word[:1000] + "x" + word[1001:]])
    assert len(key) < 600_000 and (high >= low).all()


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 5))): rng.choice([1, 2, 15, 20, 200, 3000]) for _ in range(150)}
    counts["x" * 40_000], counts["x" * 40_001], counts["x" * 39_999 + "y"] = 1, 100, 5  # runs of one letter, very long
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n int").selectExpr("word", "n", "1 AS root", "2 AS id")
    assert {tuple(r) for r in spelling.variant_groups(df).collect()} == grouped(counts)


def test_no_words(spark):
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_a_chain_of_forms_has_one_root(spark):
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefghijk": 10_000, "abcdefghijkl": 100_000}
    rows = spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    assert {r["root"] for r in rows} == {"abcdefghijkl"} and {tuple(r) for r in rows} == grouped(counts)


def words_of(docs):
    import re

    out = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def test_query_against_all_pairs(spark, tmp_path, make_docs, odd_texts):
    rng = random.Random(5)
    stems = ["concerning", "Straßenbau", "éléphants", "handles", "MEASURE", "a×b÷cdefg"]
    texts = odd_texts + [" ".join(rng.choice(stems) + rng.choice(["", "", "s", "-1"]) for _ in range(200)) for _ in range(30)] + [None]
    docs = make_docs(texts)
    docs.union(docs.limit(3)).union(docs.limit(20).selectExpr("null", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    got = {tuple(r) for r in spelling.query_variants(spark, str(tmp_path)).collect()}
    assert got == grouped(words_of(rows)) and any(r[1] for r in got)


def test_query_against_its_twin(spark, data, duck):
    assert_same(spelling.query_variants(spark, data).toPandas(), duck.execute(queries.ORACLE_SQL["op11_symmetric_delete_variants"]).df())
