"""Rate fits and noise floors against plain versions, at sizes that no driver would hold comfortably."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import evaluation, profile


def dense(rows, features, ridge, steps=100):
    """Newton steps on the whole design matrix."""
    names = sorted({(f, r[f]) for r in rows for f in features})
    index = {name: k + 1 for k, name in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        for f in features:
            x[i, index[f, r[f]]] = 1
    e, n = (np.array([float(r[k]) for r in rows]) for k in "en")
    w = np.zeros(x.shape[1])
    w[0] = np.log(max(e.sum(), 0.5) / max(n.sum(), 1))
    penalty = np.full(len(w), ridge)
    penalty[0] = 0
    for _ in range(steps):
        mean = n * np.exp(x @ w)
        step = np.linalg.solve(x.T @ (x * mean[:, None]) + np.diag(penalty + 1e-9), x.T @ (e - mean) - penalty * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return {("", ""): w[0]} | {name: w[k] for name, k in index.items()}


@pytest.mark.parametrize("ridge", [0.5, 8.0])
def test_fit_equals_the_dense_one(spark, ridge):
    rng = np.random.default_rng(2)
    rows = [{"a": f"a{rng.integers(5)}", "b": f"b{rng.integers(3)}", "c": f"c{rng.integers(9)}", "e": int(rng.integers(0, 9)), "n": int(rng.integers(10, 200))} for _ in range(300)]
    fit = profile.fit_log_linear(spark.createDataFrame(rows).repartition(5), ["a", "b", "c"], "e", "n", ridge)
    expected = dense(rows, ["a", "b", "c"], ridge)
    assert set(fit) == set(expected) and all(abs(fit[k] - expected[k]) < 1e-6 for k in fit)


def test_fit_of_a_million_combinations(spark):
    value = lambda k: F.concat(F.lit("v"), (F.shiftright("id", 5 * k).bitwiseAND(F.lit(31))).cast("string"))
    rows = spark.range(1 << 20).select(*[value(k).alias(f"f{k}") for k in range(4)], F.lit(100).alias("n"))
    truth = sum((F.substr(F.col(f"f{k}"), F.lit(2)).cast("double") - 15.5) * (k + 1) / 200 for k in range(4)) - 2
    rows = rows.withColumn("e", 100 * F.exp(truth))
    fit = profile.fit_log_linear(rows, [f"f{k}" for k in range(4)], "e", "n", ridge=1e-3)
    for k in range(4):
        for v in range(32):
            assert abs(fit[f"f{k}", f"v{v}"] - (v - 15.5) * (k + 1) / 200) < 1e-4


def test_fit_without_places_and_with_nulls(spark):
    df = spark.createDataFrame([("x", 1, 10), (None, 3, 10)], "a string, e int, n int")
    fit = profile.fit_log_linear(df, ["a"], "e", "n")
    assert set(fit) == {("", ""), ("a", "x"), ("a", "None")} and fit["a", "None"] > fit["a", "x"]
    assert set(profile.fit_log_linear(df.limit(0), ["a"], "e", "n")) == {("", "")}


@pytest.mark.parametrize("together", [2, 4096])
def test_noise_floor_against_plain_draws(spark, monkeypatch, together):
    monkeypatch.setattr(profile, "DRAWN_TOGETHER", together)
    counts = np.array([500, 300, 100, 50, 30, 20, 9, 5, 2, 1])
    df = spark.createDataFrame([(f"v{k}", int(c)) for k, c in enumerate(counts)] + [("none", 0), (None, None)], "value string, n bigint")
    got = profile.noise_floor(df, 200, 400, "floor").first()
    p = counts / counts.sum()
    tv = 0.5 * np.abs(np.random.default_rng(5).multinomial(200, p, 4000) / 200 - p).sum(1)
    assert abs(got["mean"] - tv.mean()) < 5 * tv.std() / 20 and abs(got["p95"] - np.quantile(tv, 0.95)) < 0.02
    assert tuple(got) == tuple(profile.noise_floor(df.repartition(3), 200, 400, "floor").first())


def test_noise_floor_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.col("id").cast("string").alias("value"), F.lit(3).alias("n"))
    got = profile.noise_floor(df, 1_000_000, 3, "many").first()
    assert abs(got["mean"] - np.exp(-1)) < 0.002  # half the mean gap of a Poisson count of mean one
    assert profile.noise_floor(df.limit(0), 10, 3, "x").first()["mean"] is None


def test_epoch_sample_against_sorting(spark):
    import hashlib

    rows = [(i, i % 7 == 0, i % 5 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, bad boolean, hard boolean")
    got = sorted(r["id"] for r in evaluation.epoch_sample(df, F.col("bad"), F.col("hard"), 1.7, "s", "id").collect())
    errors = [i for i, bad, _ in rows if bad]
    clean = sorted((i for i, bad, _ in rows if not bad), key=lambda i: (i % 5 != 0, hashlib.md5(f"s|{i}".encode()).hexdigest()))
    assert got == sorted(errors + clean[: int(1.7 * len(errors))])
