"""Feature histograms of sentences and edits, rates, and a log-linear fit over them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import segment as S
from corpuslab.functions import text as T
from corpuslab.session import dropped, written


def shape_features(s: Column) -> list[Column]:
    """Features of a sentence as string columns."""
    return [
        S.length_bucket(T.word_count(s)).alias("length"),
        F.least(T.count_of(s, ","), F.lit(3)).cast("string").alias("commas"),
        s.rlike("[0-9]").cast("string").alias("digits"),
        s.rlike(r"[«»\"]").cast("string").alias("quotes"),
        s.rlike(r"[()\[\]]").cast("string").alias("brackets"),
        F.right(s, F.lit(1)).rlike(r"[.!?…]").cast("string").alias("closed"),
    ]


def long_features(df: DataFrame, keys: list[str], features: list[Column]) -> DataFrame:
    """(keys, feature, value): one row a feature. Aggregated at once, it never grows beyond the map side."""
    wide = df.select(*keys, *features)
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, names, "feature", "value")


def event_tables(places: DataFrame, features: list[str], event: str) -> DataFrame:
    """(feature, value, events, places): the sufficient statistics of a rate model."""
    long = places.select(event, *features).unpivot([event], features, "feature", "value")
    return long.groupBy("feature", "value").agg(F.sum(F.col(event).cast("long")).alias("events"), F.count(F.lit(1)).alias("places"))


def _moments(features: int, shared):
    """Combinations (features, e, n) -> (k, l, value): by batch, the slope of each weight (l = -1) and the curvature of each pair that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        size = len(weights)
        for batch in batches:
            if not len(batch):
                continue
            active = np.zeros((features + 1, len(batch)), np.int64)  # weight 0 is the level, which every row has
            for f in range(features):
                values = batch.column(f).dictionary_encode()
                own = np.array([index[f, v] for v in values.dictionary.to_pylist()], np.int64)
                active[f + 1] = own[values.indices.to_numpy()]
            e, n = (batch.column(features + k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
            mean = n * np.exp(np.clip(weights[active].sum(0), -30, 30))
            slope = np.zeros(size)
            for own in active:
                slope += np.bincount(own, e - mean, size)
            pairs = (active[:, None, :] * size + active[None, :, :]).reshape(-1)
            at, back = np.unique(pairs, return_inverse=True)
            bend = np.bincount(back, np.broadcast_to(mean, (features + 1, features + 1, len(mean))).reshape(-1), len(at))
            some = np.flatnonzero(slope)
            columns = [np.concatenate([some, at // size]), np.concatenate([np.full(len(some), -1), at % size]), np.concatenate([slope[some], bend])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "l", "value"])

    return run


def fit_log_linear(table: DataFrame, features: list[str], events: str, exposure: str, ridge: float = 1.0, steps: int = 100) -> dict[tuple[str, str], float]:
    """Poisson log-linear rates by damped Newton steps: log rate = level + one weight for each feature's value.

    The combinations of feature values are aggregated and written once. Each step sums slope and curvature over them on
    the executors; the driver holds the weights and their curvature, so the square of the number of values, whatever the
    number of places and of combinations. A null value is the value "None"; without places the level is that of half an event."""
    spark = table.sparkSession
    named = [F.coalesce(F.col(f).cast("string"), F.lit("None")).alias(f"_f{k}") for k, f in enumerate(features)]
    keys = [f"_f{k}" for k in range(len(features))]
    rows = table.select(*named, F.col(events).cast("double").alias("_e"), F.col(exposure).cast("double").alias("_n"))
    combos = written(rows.groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_n").alias("_n")), "rate-combinations")
    found = combos.select(F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("v")) for k, c in enumerate(keys)])).alias("x")).select("x.*").distinct().collect()
    names = sorted((r["f"], r["v"]) for r in found)
    index = {name: k + 1 for k, name in enumerate(names)}
    e, n = combos.agg(F.coalesce(F.sum("_e"), F.lit(0.0)), F.coalesce(F.sum("_n"), F.lit(0.0))).first()
    weights = np.zeros(len(names) + 1)
    weights[0] = np.log(max(e, 0.5) / max(n, 1.0))
    penalty = np.full(len(weights), ridge)
    penalty[0] = 0
    for _ in range(steps if names else 0):
        shared = spark.sparkContext.broadcast((index, weights))
        sums = combos.mapInArrow(_moments(len(features), shared), "k bigint, l bigint, value double").groupBy("k", "l").agg(F.sum("value").alias("value"))
        slope, bend = np.zeros(len(weights)), np.diag(penalty + 1e-9)
        for r in sums.collect():
            if r["l"] < 0:
                slope[r["k"]] += r["value"]
            else:
                bend[r["k"], r["l"]] += r["value"]
        shared.destroy()
        step = np.linalg.solve(bend, slope - penalty * weights)
        weights = weights + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    dropped(combos)
    return {("", ""): float(weights[0])} | {(features[f], v): float(weights[k]) for (f, v), k in index.items()}


#: Values of a distribution that are drawn in one piece.
DRAWN_TOGETHER = 4096


def _dealt(shared, n: int, seed: int):
    """(r) -> (bucket, r, k): how many of the ``n`` draws of a replicate fall into each bucket, from its share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = shared.value
        for batch in batches:
            for r in batch.column(0).to_pylist():
                k = np.random.default_rng([seed, r]).multinomial(n, share)
                for low in range(0, len(k), 1 << 16):
                    part = np.arange(low, min(len(k), low + (1 << 16)))
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(np.full(len(part), r, np.int64)), pa.array(k[part].astype(np.int64))], ["bucket", "r", "k"])

    return run


def _strayed(total: float, n: int, seed: int):
    """(bucket, weights, draws) -> (r, gap): the sum of the gaps between the bucket's shares and those of its draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, weights, draws in zip(*(batch.column(i) for i in range(3)), strict=True):
                w = weights.values.to_numpy(zero_copy_only=False).astype(float)
                pairs = sorted((x["r"], x["k"]) for x in draws.as_py())
                gaps = [np.abs(w / total - np.random.default_rng([seed, r, bucket.as_py() + 1]).multinomial(k, w / w.sum()) / n).sum() for r, k in pairs]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in pairs], pa.int64()), pa.array(gaps, pa.float64())], ["r", "gap"])

    return run


def noise_floor(counts: DataFrame, n: int, replicates: int, seed: str) -> DataFrame:
    """(mean, p95) of the total variation between a distribution (value, n) and samples of ``n`` draws from it.

    A sample is drawn in two levels: how many of its draws fall into each bucket of values, by the buckets' shares, and
    then which values they are, bucket by bucket. So no task holds more than a bucket of values, no draw is a row, and
    the work is values times replicates. Generators are seeded by replicate and bucket: the floor is the same on every run.
    The driver sees one sum a bucket. Values without a positive count are left out; an empty distribution gives nulls."""
    spark, number = counts.sparkSession, zlib.crc32(seed.encode())
    rows = counts.select(F.col("value").cast("string").alias("value"), F.col("n").cast("double").alias("w")).where("w > 0").groupBy("value").agg(F.sum("w").alias("w"))
    buckets = max(1, rows.count() // DRAWN_TOGETHER)
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("long"))
    sums = np.zeros(buckets)
    for r in placed.groupBy("bucket").agg(F.sum("w").alias("w")).toLocalIterator():
        sums[r["bucket"]] = r["w"]
    total = float(sums.sum())
    if not total:
        return spark.range(1).select(F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("p95"))
    share = spark.sparkContext.broadcast(sums / total)
    dealt = spark.range(replicates).mapInArrow(_dealt(share, n, number), "bucket bigint, r bigint, k bigint")
    drawn = dealt.groupBy("bucket").agg(F.collect_list(F.struct("r", "k")).alias("draws"))
    packed = placed.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("value", "w")))["w"].alias("weights"))
    gaps = packed.join(drawn, "bucket").select("bucket", "weights", "draws").mapInArrow(_strayed(total, n, number), "r bigint, gap double")
    tv = gaps.groupBy("r").agg((0.5 * F.sum("gap")).alias("tv"))
    return tv.agg(F.avg("tv").alias("mean"), F.percentile("tv", 0.95).alias("p95"))
