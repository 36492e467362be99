import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import mixing, sharding
from tests.llm.conftest import prose


def test_hypergeometric_has_its_mean_and_spread():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    mean = sum(draws) / 4000
    var = sum((x - mean) ** 2 for x in draws) / 4000
    assert abs(mean - 30) < 0.4 and abs(var - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert abs(sharding.hypergeometric(rng, 10**12, 10**12, 10**9) - 5 * 10**8) < 10**6


def test_matrix_has_exact_margins():
    sizes = [0, 7, 1000, 13, 1]
    matrix = sharding.communication_matrix(sizes, 3, 5)
    assert [sum(r) for r in matrix] == sizes
    assert sorted(sum(c) for c in zip(*matrix, strict=True)) == [340, 340, 341]


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_shards_are_exact_and_slots_gapless(spark, n):
    df = spark.range(n).select((F.col("id") % 300).alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("slot"), F.lit(2).alias("block"))
    rows = sharding.shard(df, 8, blocks=5).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and (n < 8 or max(sizes.values()) - min(sizes.values()) <= 1)
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert n == 0 or rows[0]["block"] == 2


def test_a_row_repeated_very_often_fills_no_block_alone(spark):
    df = spark.range(41_000).select(F.when(F.col("id") < 40_000, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("rank"))
    out = sharding.shard(df, 4, blocks=16)
    rows = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("k"), F.max("slot").alias("m"), F.count_if(F.col("doc_id") == -1).alias("hot")).collect()
    assert all(r["n"] == r["k"] == 10_250 and r["m"] == 10_249 and abs(r["hot"] - 10_000) < 150 for r in rows) and len(rows) == 4
    again = sharding.shard(df.repartition(5), 4, blocks=16)
    assert out.exceptAll(again).isEmpty() and again.exceptAll(out).isEmpty()


def test_shuffle_is_uniform(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"))
    out = sharding.shard(rows, 4).withColumn("part", F.floor(F.col("doc_id") / 1000)).withColumn("where", F.floor(F.col("slot") / 500))
    counts = [r["n"] for r in out.groupBy("part", "shard", "where").agg(F.count(F.lit(1)).alias("n")).collect()]
    chi = sum((c - 62.5) ** 2 / 62.5 for c in counts) + (128 - len(counts)) * 62.5
    assert 60 < chi < 200  # some 100 degrees of freedom


def test_rows_law_query(spark, data):
    rows = sharding.query_shard(spark, data).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1 and {r["law"] for r in rows} == {"rows"}
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.query_shard(spark, data).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def allocate(sizes, weights, total, cap):
    """Targets in proportion to the weights, none above its cap, source by source."""
    targets, fixed = [0.0] * len(sizes), [False] * len(sizes)
    while not all(fixed):
        rest = [i for i, done in enumerate(fixed) if not done]
        budget = total - sum(t for t, done in zip(targets, fixed, strict=True) if done)
        for i in rest:
            targets[i] = budget * weights[i] / sum(weights[k] for k in rest)
        above = [i for i in rest if targets[i] > cap * sizes[i]]
        if not above:
            break
        for i in above:
            targets[i], fixed[i] = float(cap * sizes[i]), True
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [0, 10], [], [0, 0], [5, 1000, 1, 1, 400, 3, 80], [10, 1, 1, 1]])
def test_allocation(spark, sizes):
    names = [None if i == len(sizes) - 1 and i > 1 else f"s{i:03}" for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, z bigint")
    got = {r["source"]: r["t"] for r in mixing.allocated(df, (3, 1, 2), 1.5, 2.0).collect()}
    expected = allocate(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2.0)
    assert [got[n] for n in names] == pytest.approx(expected)


def test_many_sources_are_weighed_in_code_point_order(spark):
    sources = [chr(97 + k % 26) * (1 + k // 26) for k in range(3000)]
    df = spark.createDataFrame([(s, 1000) for s in sources], "source string, z bigint")
    got = {r["source"]: r["t"] for r in mixing.allocated(df.repartition(7), (3, 1, 2), 1.5, 2.0).collect()}
    expected = allocate([1000] * 3000, [(3, 1, 2)[i % 3] for i in range(3000)], 1.5 * 3_000_000, 2.0)
    assert [got[s] for s in sorted(sources)] == pytest.approx(expected)


def test_the_extra_copies_are_the_first_in_pareto_order(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(5, 60)), rng.choice("ab")) for i in range(400)]
    df = mixing.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    out = mixing.copies(df, df).collect()
    for source in "ab":
        own = [r for r in out if r["source"] == source]
        words = {}
        for r in own:
            words[r["mix_class"]] = words.get(r["mix_class"], 0) + r["mix_size"]
        expect = mixing.expected_copies(words, own[0]["mix_target"], 2.0)
        whole = {k: int(e + 1e-9) for k, e in expect.items()}
        left = own[0]["mix_target"] - sum(words[k] * whole[k] for k in words)

        def odds(r):
            u, p = (((r["mix_draw"] % 2**64) >> 12) + 0.5) / 2**52, expect[r["mix_class"]] - whole[r["mix_class"]]
            return u * (1 - p) / (u * (1 - p) + (1 - u) * p)

        took, got = set(), 0
        for r in sorted((r for r in own if expect[r["mix_class"]] - whole[r["mix_class"]] > 1e-9), key=odds):
            if got + r["mix_size"] > left and got + r["mix_size"] - left >= left - got:
                break
            took.add(r["doc_id"])
            got += r["mix_size"]
            if got > left:
                break
        assert {r["doc_id"] for r in own if r["mix_copies"] > whole[r["mix_class"]]} == took


def docs(spark, odd_texts):
    rng = random.Random(6)
    rows = [(i, prose(rng, int(rng.paretovariate(1.1) * 5)), rng.choice(["a", "b", "é", None, "B"])) for i in range(900)]
    rows += [(1000 + i, t, "odd") for i, t in enumerate(odd_texts)] + [(5, "same text", "a")] * 4 + [(None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("bucket", F.lit(9)).withColumn("s", F.lit("s"))


def test_mix_meets_targets(spark, odd_texts):
    df = docs(spark, odd_texts)
    rows = mixing.sized(df)
    light = rows.select("doc_id", "source", "mix_size", "mix_class", "mix_draw")
    out = mixing.copies(light, light).collect()
    total = sum(r["mix_size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["mix_copies"] <= 2 and (r["mix_size"] > 0 or r["mix_copies"] == 0)
    weights = dict(zip(sorted(by, key=lambda s: (s is None, (s or "").encode())), [3, 1, 2] * 3, strict=False))
    names = list(weights)
    expected = allocate([sum(r["mix_size"] for r in by[s]) for s in names], [weights[s] for s in names], 1.5 * total, 2.0)
    for s, target in zip(names, expected, strict=True):
        assert by[s][0]["mix_target"] == pytest.approx(target)
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in by[s]) - target) <= max(0.02 * target, 0.5 * max(r["mix_size"] for r in by[s]))


def test_mix_keeps_columns_and_reruns_agree(spark, odd_texts):
    df = docs(spark, odd_texts)
    a, b = (sorted(map(repr, mixing.mix(df.repartition(n)).collect())) for n in (2, 5))
    assert a == b and mixing.mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_inclusion_follows_importance(spark):
    """Pareto sampling: the share taken of each class is near its expected number of copies."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 1 if i % 2 else 12), "a" if i < 6000 else "b") for i in range(9000)]
    light = mixing.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).drop("text")
    sums = light.where("source = 'a'").groupBy("mix_class").agg(F.sum("mix_size").alias("w")).collect()
    out = mixing.copies(light, light, share=0.9).where("source = 'a'")
    expect = mixing.expected_copies({r["mix_class"]: r["w"] for r in sums}, out.first()["mix_target"], 2.0)
    for r in out.groupBy("mix_class").agg(F.avg("mix_copies").alias("k")).collect():
        assert abs(r["k"] - expect[r["mix_class"]]) < 0.05
