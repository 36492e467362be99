import numpy as np
import pytest

from corpuslab.llm import embedding_dedup as E


def brute(rows, least=0.98):
    ids = [r[0] for r in rows]
    links, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def good(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:i]:
            if la is None or la != lb or not good(x) or not good(y) or len(x) != len(y):
                continue
            u, v = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i in ids}


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 14)):
            rows.append((base * rng.uniform(0.5, 2) + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.13, 0.16]), int(g % 3)))
    rows += [(rng.normal(size=64), None), (np.zeros(64), 1), (None, 1), ([], 1), ([np.nan] * 64, 1), ([np.inf] + [0.0] * 63, 1), ([None] + [1.0] * 63, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    order = rng.permutation(len(rows))
    return [(k, None if rows[i][0] is None else [None if c is None else float(np.float32(c)) for c in rows[i][0]], rows[i][1]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("cell", "chunk"), [(8192, 4096), (8192, 7), (20, 4096), (4, 5)])
def test_against_brute_force(spark, cell, chunk):
    rows = vectors(cell + chunk)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df, cell=cell, chunk=chunk).collect()}
    assert out == brute(rows)


def test_empty_table(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_query_keeps_the_smallest(spark, data):
    rows = E.query_near_vectors(spark, data).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows) and len(rows) == 500


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1.01e200], 0), (3, [1e-200, 1e-200], 0), (4, [-1e200, 1e200], 0)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_a_large_label_is_never_written_as_many_copies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    rows = [(i, [float(np.float32(c)) for c in base[i // 2] + rng.normal(size=64) * 0.1 * (i % 2)], 0) for i in range(600)]
    written, staged = [], E.staged
    monkeypatch.setattr(E, "staged", lambda df, name: written.append((name, staged(df, name))) or written[-1][1])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df, cell=50).collect()}
    assert out == brute(rows) and sum(n for n, _ in out.values()) > 500
    held = [t.count() for name, t in written if name in ("vec-nodes", "vec-dealt", "vec-links")]
    assert max(held) <= 2 * len(rows)  # by grids of eight blocks a vector was written some hundred times
    assert len(held) > 6  # the comparisons came in slices
