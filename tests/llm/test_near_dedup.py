import random
import re

import numpy as np
import pytest

from corpuslab.llm import kernels as K
from corpuslab.llm import near_dedup as N
from corpuslab.llm.components import connected_components
from tests.llm.conftest import prose

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(texts, width, least=0.8):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= least * len(a | b) - 1e-12:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def corpus(rng, groups=12, copies=8):
    texts = []
    for g in range(groups):
        base = prose(rng, rng.choice([4, 9, 30, 120, 400])).split()
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


def check(spark, make_docs, texts, width):
    out = N.near_duplicates(make_docs(texts), width=width).collect()
    expected, sizes = brute(texts, width)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in out} == {i: (c, n) for i, (c, n) in enumerate(zip(expected, sizes, strict=True))}


def test_against_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(4)
    check(spark, make_docs, corpus(rng) + odd_texts + odd_texts, 2)


def test_five_words_and_borderline_cloud(spark, make_docs):
    """Many copies about the threshold: links between them, not only to the first."""
    rng = random.Random(9)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(60):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(2, 7)):
            words[k] = prose(rng, 1)
        texts.append(" ".join(words))
    check(spark, make_docs, texts, 5)


def test_small_parts_change_nothing(spark, make_docs, monkeypatch):
    rng = random.Random(7)
    texts = corpus(rng, 5, 20)
    monkeypatch.setattr(N, "PART", 3)
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "QUERIES", 2)
    monkeypatch.setattr(N, "STAR_TURNS", 0)
    check(spark, make_docs, texts, 2)


def test_null_ids_follow_their_text(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(None, words), (7, words), (5, words + " more"), (None, "alone here"), (9, None)]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert sorted(((r["doc_id"] or -1), (r["component_id"] or -1)) for r in out) == [(-1, -1), (-1, 5), (5, 5), (7, 5), (9, 9)]


def test_empty_table(spark, make_docs):
    assert N.near_duplicates(make_docs([])).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for n, shared in ((2000, 1600), (300, 240), (40, 32)):
        got = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            a, b = (np.unique(np.concatenate([both[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in "ab")
            got.append(N.estimate(N.registers(a), N.registers(b), n))
        assert abs(np.mean(got) - shared / (2 * n - shared)) < 0.03


def test_chance_collisions():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2)) for _ in "ab")
    measured = np.mean([(N.registers(np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))) == N.registers(np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)))).mean() for _ in range(200)])
    assert measured < 5 * N.chance_collision(4000 / 256) + 1e-3 and len(a) == len(b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(k, k + 1) for k in range(400, 520)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_word_hashes_ignore_ascii_case_only():
    data = np.frombuffer("Ab ab É é".encode(), np.uint8)
    h = K.Words(data, np.array([0, len(data)]), K.SPACE_WORDS).hash
    assert h[0] == h[1] and h[2] != h[3]


@pytest.mark.parametrize("width", [2, 5])
def test_components_of_the_table_equal_an_exact_join(spark, data, width):
    """All pairs whose sizes allow a link, by sets of words and not of hashes."""
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower))
        whole = [tuple(words)] if words else []
        sets[r["doc_id"]] = frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset(whole)
    component = {i: i for i in sets}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                component[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, width=width).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}
