import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from corpuslab.llm import suffix_sort as S
from corpuslab.llm.anchors import find_anchors
from corpuslab.llm.external import Sorter, Vector
from corpuslab.llm.substring_dedup import remove_repeats
from tests.llm.conftest import prose


def brute(texts, length):
    seen, raw = {}, [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def texts(rng):
    shared = [prose(rng, 12) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [prose(rng, rng.randint(1, 30))] + ([rng.choice(shared)] if rng.random() < 0.5 else []) + [prose(rng, rng.randint(0, 20))]
        out.append(" ".join(parts))
    base = prose(rng, 60).split()
    for _ in range(20):
        words = list(base)
        words[rng.randrange(60)] = "é" + prose(rng, 1)
        out.append(" ".join(words))
    return out + ["a" * 300, "b" * 299, "ab" * 90, None, "", "short", out[0], out[0], prose(rng, 20) * 3]


@pytest.mark.parametrize("memory", [1 << 26, 500])
def test_against_brute_force(spark, make_docs, memory):
    own = texts(random.Random(memory))
    out = remove_repeats(make_docs(own), carry=["doc_id"], length=40, shard_bytes=2000, memory=memory, with_text=True).collect()
    expected = brute(own, 40)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == dict(enumerate(expected))


@pytest.mark.parametrize("shard_bytes", [500, 4000])
def test_a_hot_passage_in_many_surroundings(spark, make_docs, shard_bytes):
    rng = random.Random(shard_bytes)
    passage, other = prose(rng, 14), prose(rng, 9)
    own = [prose(rng, rng.randint(2, 12)) + " " + passage + " " + rng.choice([prose(rng, 8), other + " " + prose(rng, 2)]) for _ in range(60)]
    own += [prose(rng, 20) for _ in range(10)] + [own[0], own[1][5:]]
    out = remove_repeats(make_docs(own), carry=["doc_id"], length=40, shard_bytes=shard_bytes).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == dict(enumerate(brute(own, 40)))


def test_repeated_rows_repeat_each_other(spark):
    text = prose(random.Random(1), 40)
    df = spark.createDataFrame([(1, text), (1, text), (2, "x" + text[10:]), (None, text[:60])], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(df, length=50).collect())
    assert got == [(0, 60), (1, len(text)), (1, len(text)), (2, len(text) - 10)]


def test_empty_table_and_clashing_names(spark, make_docs):
    assert remove_repeats(make_docs([])).count() == 0
    df = spark.createDataFrame([(1, "a b", "k", 5)], "doc_id bigint, text string, key string, n_bytes int")
    row = remove_repeats(df).first()
    assert row["n_bytes"] == 5 and row["_n_bytes"] == 3 and row["key"] == "k"


def test_anchor_windows_cover_every_start_once():
    rng = random.Random(5)
    rows = [prose(rng, rng.randint(1, 80)).encode() for _ in range(30)] + [b"", b"z" * 200]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    found = find_anchors(data, offsets, 40, 16)
    starts = sorted((int(r), k) for r, a, b in zip(found.row, found.first, found.last, strict=True) for k in range(a, b + 1))
    assert starts == [(i, k) for i, r in enumerate(rows) for k in range(len(r) - 39)]
    by_window = {}
    for r, p, a, b, h in zip(found.row, found.place, found.first, found.last, found.anchor, strict=True):
        for k in range(a, b + 1):
            by_window.setdefault(rows[r][k : k + 40], set()).add((int(h), int(p - k)))
    assert all(len(v) == 1 for v in by_window.values())


def vector(text, memory):
    out = Vector(np.uint8, memory // 8)
    out.append(np.array(text, np.uint8))
    return out


def check_order(text, cap, memory):
    """Order and common prefixes against sorting the suffixes themselves."""
    end, ends = len(text), {}
    for i in reversed(range(len(text))):
        end = ends[i] = i if text[i] == 0 else end
    keys = {i: [(c, 0) for c in text[i : ends[i]]] + [(0, ends[i])] for i in range(len(text)) if text[i]}
    order = sorted(keys, key=keys.get, reverse=True)
    common = [0] + [min(cap, next(k for k, (u, v) in enumerate(zip(keys[x], keys[y], strict=False)) if u != v)) for x, y in zip(order, order[1:], strict=False)]
    got = list(S.sorted_suffixes(vector(text, memory), cap, memory))
    assert np.concatenate([g[0] for g in got]).tolist() == order
    assert np.concatenate([g[1] for g in got]).tolist() == common


@pytest.mark.parametrize("in_memory", [True, False])
@pytest.mark.parametrize("memory", [64, 2000, 1 << 20])
def test_suffix_order_and_common_prefixes(monkeypatch, in_memory, memory):
    if not in_memory:
        monkeypatch.setattr(S, "NAME_BYTES", 1 << 40)  # the recursion goes to its end
    rng = random.Random(memory)
    for _ in range(40):
        letters = rng.choice([1, 2, 3, 26])
        base, text = [rng.randint(1, letters) for _ in range(rng.randint(1, 30))], []
        for _ in range(rng.randint(1, 6)):
            text += [rng.randint(1, letters) for _ in range(rng.randint(0, 8))] + (base if rng.random() < 0.5 else []) + [rng.randint(1, letters), 0]
        check_order(text, rng.choice([3, 8, 400]), memory)


@pytest.mark.parametrize("seed", range(4))
def test_long_repeats_in_many_batches(monkeypatch, seed):
    monkeypatch.setattr(S, "NAME_BYTES", 1 << 40)
    rng = random.Random(seed)
    letters, base, text = rng.choice([2, 4, 26]), [], []
    base = [rng.randint(1, letters) for _ in range(300)]
    while len(text) < 3000:
        a = rng.randrange(300)
        text += [rng.randint(1, letters) for _ in range(rng.randint(0, 40))] + base[a : a + rng.randint(0, 200)] + [1] + [0] * (rng.random() < 0.3)
    check_order([*text, 0], 400, 8000)


PEAK = """
import resource, sys
import numpy as np
from corpuslab.llm import suffix_sort as S
from corpuslab.llm.external import Vector
memory, text, rng = int(sys.argv[1]), Vector(np.uint8, 1 << 17), np.random.Generator(np.random.PCG64(1))
words = rng.integers(98, 124, (3000, 7)).astype(np.uint8)
while len(text) < memory:
    block = words[(rng.random(9000) ** 3 * 3000).astype(int)].ravel()
    block[::640] = 0
    block[-1] = 0
    for k in range(0, len(block) - 1000, 3200):
        block[k + 100 : k + 400] = words.ravel()[:300]
    text.append(block)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
runs = sum(len(a) for a, _ in S.repeated_runs(text, 200, memory))
assert runs >= len(text) // 3300
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_memory_is_bounded_with_all_on_disk():
    memory = 1 << 19
    done = subprocess.run([sys.executable, "-c", PEAK, str(memory)], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) * 1024 < 4 * memory + (20 << 20)  # blocks that are read, and the interpreter's own


def test_sorter_merges_runs():
    rng = np.random.Generator(np.random.PCG64(3))
    a, b = rng.integers(0, 50, 5000), rng.integers(0, 9, 5000)
    sorter = Sorter([np.int64, np.int64, np.int64], 2, 4000)
    for k in range(0, 5000, 70):
        sorter.add(a[k : k + 70], b[k : k + 70], np.arange(5000)[k : k + 70])
    parts = list(sorter.read(200))
    order = np.lexsort((b, a))
    assert (np.concatenate([p[0] for p in parts]) == a[order]).all() and (np.concatenate([p[1] for p in parts]) == b[order]).all()
    assert sorted(np.concatenate([p[2] for p in parts])) == list(range(5000))
