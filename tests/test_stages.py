import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import maths
from corpuslab.operators import lexicon, profile, stages, synth
from corpuslab.streaming import events


def marker(word, rule):
    """A model for tests: finds a word."""

    def load():
        return lambda t: [(t.index(word), t.index(word) + len(word), "error", rule, None, 0.9)] if word in t else []

    return load


def rows(spark):
    return spark.createDataFrame([(0, "a cat"), (1, "dog and cat"), (2, None), (3, "")], "idx bigint, text string")


def test_stages_run_in_order_and_resume(spark):
    two = [stages.Stage("cats", 0.1, marker("cat", "CAT")), stages.Stage("dogs", 0.5, marker("dog", "DOG"))]
    got = sorted((r["stage"], r["idx"], r["start"], r["end"]) for r in stages.run_stages(rows(spark), two).collect())
    assert got == [("cats", 0, 2, 5), ("cats", 1, 8, 11), ("dogs", 1, 0, 3)]
    assert sorted((r["stage"], r["idx"]) for r in stages.run_stages(rows(spark), two, ("cats", 1)).collect()) == [("cats", 1), ("dogs", 1)]
    assert [r["stage"] for r in stages.run_stages(rows(spark), two, ("dogs", 0)).collect()] == ["dogs"]
    assert [(r["stage"], r["steps"], r["seconds"]) for r in stages.plan(rows(spark), two).orderBy("place").collect()] == [("cats", 4, 0.4), ("dogs", 4, 2.0)]
    with pytest.raises(ValueError):
        stages.run_stages(rows(spark), two, ("none", 0))


def test_a_model_is_loaded_only_if_there_are_rows(spark):
    def load():
        raise AssertionError("loaded")

    assert stages.run_stage(rows(spark).where("idx > 9"), stages.Stage("x", 1.0, load)).count() == 0


def test_predictions_are_cached(spark, tmp_path):
    df = rows(spark).where("text <> ''")
    out = stages.predictions(df, "idx", "text", str(tmp_path / "p"), lambda: len)
    assert sorted(map(tuple, out.collect())) == [(0, 5.0), (1, 11.0)]

    def load():
        raise AssertionError("computed again")

    assert stages.predictions(df, "idx", "text", str(tmp_path / "p"), load).count() == 2


def test_two_sinks(spark, data, tmp_path):
    stream = events.event_stream(spark, data)
    stages.in_two_sinks(stream, str(tmp_path / "a"), str(tmp_path / "b"), "event_type = 'view'", str(tmp_path / "c")).awaitTermination()
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert b.count() == a.where("event_type = 'view'").count() > 0


def test_maths(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1000.0], [2.0, 0.5, 3.0])], "x array<double>, f array<double>")
    p, k = df.select(maths.softmax(F.col("x")), maths.product(F.col("f"))).first()
    assert sum(p) == pytest.approx(1) and p[2] == pytest.approx(1) and k == 3.0
    u = spark.range(20_000).select(maths.poisson((F.col("id") + 0.5) / 20_000, 1.7).alias("k"))
    mean, var = u.agg(F.avg("k"), F.var_pop("k")).first()
    assert mean == pytest.approx(1.7, abs=0.01) and var == pytest.approx(1.7, abs=0.02)
    assert spark.range(1).select(maths.capped_rate(F.lit(0.5), F.lit(3.0))).first()[0] == 0.6


def test_placed_errors_have_their_rate_and_cap(spark):
    places = spark.range(20_000).select((F.col("id") / 20).cast("int").alias("doc_id"), (F.col("id") % 20).cast("int").alias("word_no"))
    out = synth.placed(places, ["doc_id"], F.when(F.col("word_no") < 10, 0.1).otherwise(0.02), "s", 2)
    n = out.groupBy("doc_id").count()
    assert n.agg(F.max("count")).first()[0] == 2
    assert 0.07 < out.where("word_no < 10").count() / 10_000 < 0.1 and 0.01 < out.where("word_no >= 10").count() / 10_000 < 0.022


def test_spelling_errors_are_undone():
    rng = random.Random(4)
    done = 0
    for _ in range(500):
        words = [rng.choice(["Title", "notebook", "small", "two-part", "x"]) for _ in range(6)]
        at, label = rng.randrange(6), rng.choice(synth.SPELL)
        bad = synth.misspelt(words, at, label)
        if bad is not None:
            done += 1
            assert synth.respelt(bad, at, label, cut=len(words[at])) == words
    assert done > 150


def test_noise_floor_shrinks_with_the_sample(spark):
    counts = spark.createDataFrame([(v, n) for v, n in zip("abcdef", (50, 30, 10, 5, 3, 2), strict=True)], "value string, n bigint")
    small, large = (profile.noise_floor(counts, n, 40, "s").first()["mean"] for n in (50, 800))
    assert 0 < large < small / 2.5 and math.isfinite(small)


def test_words_cut_at_a_line_end(spark):
    lines = spark.createDataFrame([(1, 0, "the note-"), (1, 1, "book is well-"), (1, 2, "known. End"), (1, 3, "-")], "doc int, line_no int, line string")
    known = spark.createDataFrame([("notebook",)], "word string")
    assert [r["line"] for r in lexicon.dehyphenated(lines, known, ["doc"]).orderBy("line_no").collect()] == ["the notebook", "is well-known", ". End", "-"]
