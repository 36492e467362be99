"""Runs that are killed, stopped and resumed give the rows of one run."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import stages
from corpuslab.sources import manifests, sinks
from corpuslab.streaming import control, events

DDL = "id bigint, chunk int"


def numbers(spark, n, chunks=3):
    return spark.range(n).select("id", F.when(F.col("id") % (chunks + 1) < chunks, F.col("id") % (chunks + 1)).cast("int").alias("chunk"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_chunks_are_published_once(spark, tmp_path):
    path, df = str(tmp_path / "t"), numbers(spark, 20)
    assert manifests.published(spark, path, DDL, "chunk").count() == 0
    assert manifests.publish(df.where("chunk = 0"), path, "chunk") == 5
    assert manifests.publish(df, path, "chunk") == 15 and manifests.publish(df, path, "chunk") == 0
    assert ids(manifests.published(spark, path, DDL, "chunk")) == list(range(20))
    assert {r["chunk"] for r in manifests.winners(spark, path).collect()} == {"0", "1", "2", None}
    assert manifests.damaged(spark, path, DDL, "chunk").count() == 0


@pytest.mark.parametrize("place", ["_write", "_announce"])
def test_a_killed_run_is_never_seen(spark, tmp_path, monkeypatch, place):
    path, df, whole = str(tmp_path / "t"), numbers(spark, 20), manifests.__dict__[place]

    def killed(rows, where, *more):
        if place == "_write":  # some files are there, others are not
            whole(rows.limit(3), where, *more)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(manifests, place, killed)
        with pytest.raises(KeyboardInterrupt):
            manifests.publish(df, path, "chunk")
    assert manifests.published(spark, path, DDL, "chunk").count() == 0
    assert manifests.publish(df, path, "chunk") == 20
    assert ids(manifests.published(spark, path, DDL, "chunk")) == list(range(20))


def test_two_runs_at_once_give_each_chunk_once(spark, tmp_path, monkeypatch):
    path, df, announce = str(tmp_path / "t"), numbers(spark, 20), manifests._announce

    def late(rows, where):  # the other run begins and ends before this one is published
        monkeypatch.setattr(manifests, "_announce", announce)
        manifests.publish(df.where("chunk = 1 or id = 3").union(spark.createDataFrame([(99, 7)], DDL)), path, "chunk")
        announce(rows, where)

    monkeypatch.setattr(manifests, "_announce", late)
    manifests.publish(df, path, "chunk")
    got = ids(manifests.published(spark, path, DDL, "chunk"))
    assert len(got) == len(set(got)) and set(got) == {*range(20), 99} - {7, 11, 15, 19}  # the null chunk of the first has one row
    assert manifests.damaged(spark, path, DDL, "chunk").count() == 0


def test_lost_files_are_told(spark, tmp_path):
    path = tmp_path / "t"
    manifests.publish(numbers(spark, 20).repartition(1), str(path), "chunk")
    next(path.glob("runs/*/chunk=1/*.parquet")).unlink()
    assert [tuple(r) for r in manifests.damaged(spark, str(path), DDL, "chunk").collect()] == [("1", 5, 0)]


def test_a_cache_that_two_runs_fill_at_once(spark, tmp_path, monkeypatch):
    path, announce = str(tmp_path / "p"), manifests._announce
    a = spark.createDataFrame([("x",), ("y",)], "src string")
    compute = lambda df: df.withColumn("out", F.upper("src"))

    def late(rows, where):
        monkeypatch.setattr(manifests, "_announce", announce)
        sinks.cache_fill(a.union(spark.createDataFrame([("z",)], "src string")), "src", path, compute)
        announce(rows, where)

    monkeypatch.setattr(manifests, "_announce", late)
    out = sinks.cache_fill(a, "src", path, compute)
    assert sorted(tuple(r) for r in out.collect()) == [("x", "X"), ("y", "Y"), ("z", "Z")]


# stages


def letter(x):
    def load():
        return lambda t: [(k, k + 1, "check", x, None, 0.5) for k, c in enumerate(t) if c == x]

    return stages.Stage(x, 0.1, load)


def test_stop_and_resume_give_the_findings_of_one_run(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("idx"), F.when(F.col("id") < 30, F.lit("abca")).otherwise("none").alias("text")).where("idx not between 10 and 19")
    three = [letter("a"), letter("b"), letter("z")]
    whole = stages.run_stages(rows, three)
    asked, seen = [], []

    def stop():
        asked.append(1)
        return len(asked) in (3, 6)

    path = str(tmp_path / "run")
    while True:
        progress = control.Progress(0, {s.name: s.cost for s in three})
        done = control.run_controlled(rows, three, path, 10, stop, progress)
        seen.append((done, round(progress.fraction(), 3)))
        if done:
            break
    assert [d for d, _ in seen] == [False, False, True] and seen[0][1] < seen[1][1] < seen[2][1] == 1.0
    assert len(asked) == 3 * 4 + 2  # four batches with rows; the two that were refused are asked again
    got = control.results(rows, path)
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    assert control.run_controlled(rows, [letter("a")], path, 10, lambda: True)  # nothing left, nothing asked


def test_the_whole_check_in_one_call(spark, tmp_path):
    def finds(*found):
        return lambda: lambda t: found if "x" in t else []

    rows = spark.createDataFrame([(0, "x 123456789"), (1, "y"), (2, None)], "idx bigint, text string")
    two = [stages.Stage("rules", 0.1, finds((0, 4, "check", "A", "a", None), (5, 6, "error", "B", "b", None))), stages.Stage("model", 0.1, finds((2, 6, "error", "C", "c", 0.9), (0, 3, "check", "D", "d", 0.5), (8, 9, "candidate", "E", "e", 0.5), (9, 9, "strict", "F", "f", None)))]
    path = str(tmp_path / "whole")
    assert control.checked(rows, two, path, should_stop=lambda: True) is None
    got = control.checked(rows, two, path).collect()
    # of two errors that overlap the earlier stage's stays, and so of two checks
    assert sorted((r["idx"], r["start"], r["rule"], r["rank"]) for r in got) == [(0, 0, "A", 2), (0, 5, "B", 3), (0, 9, "F", 1)]


def test_time_left():
    now = [0.0]
    p = control.Progress(10, {"rules": 0.003, "model": 0.1, "big": 0.5}, {"big": 2}, clock=lambda: now[0])
    p.start()
    assert p.remaining() is None and p.fraction() == 0
    for _ in range(10):
        now[0] += 0.01
        p.stepped("rules")
    assert math.isclose(p.rates()["rules"], 0.01)
    now[0] += 2.0  # the model is loaded
    for _ in range(5):
        now[0] += 0.2
        p.stepped("model")
    # rows of the model at 0.2 s, twice as planned; so the two passes of the big one at 1 s, and two models to load
    assert math.isclose(p.rates()["model"], 0.2) and math.isclose(p.remaining(), 5 * 0.2 + 20 * 1.0 + 2 * 2.0)
    assert math.isclose(p.fraction(), (10 * 0.003 + 5 * 0.1) / (10 * 0.003 + 10 * 0.1 + 20 * 0.5))
    q = control.Progress(10, {"model": 0.1}, clock=lambda: now[0])
    q.skip("model", 4)
    q.start()
    assert math.isclose(q.fraction(), 0.4)
    for _ in range(6):
        now[0] += 1
        q.stepped("model")
    assert q.remaining() == 0 and q.fraction() == 1


# streams


def test_a_stopped_stream_goes_on(spark, data, tmp_path):
    source = tmp_path / "in" / "events.parquet"
    table = spark.read.parquet(f"{data}/events.parquet")
    table.repartition(4).write.parquet(str(source))
    rates, n = control.Rates(), [0]
    spark.streams.addListener(rates)

    def stop():
        n[0] += 1
        return n[0] in (2, 4)

    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    outcome, last = [], None
    while not outcome or not outcome[-1]:
        last = control.started(events.event_stream(spark, str(tmp_path / "in")), path, checkpoint, stop)
        outcome.append(control.finished(last))
    assert outcome == [False, False, True]
    schema = events.EVENTS.replace("timestamp_ntz", "timestamp") + ", _batch int"
    got = manifests.published(spark, path, schema, "_batch")
    assert ids(got.select(F.col("event_id").alias("id"))) == ids(table.select(F.col("event_id").alias("id")))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(rates)
    assert sum(x[1] for x in rates.batches[str(last.id)]) <= table.count() and str(last.id) in rates.ended


def test_other_failures_of_a_stream_are_raised(spark, data, tmp_path):
    def fail():
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        control.finished(control.started(events.event_stream(spark, data), str(tmp_path / "o"), str(tmp_path / "c"), fail))


def test_rates_of_a_listener():
    r = control.Rates()
    r.batches["q"] = [(0, 10, 9.0), (1, 10, 1.0), (2, 0, 5.0), (3, 30, 3.0)]
    assert r.rate("q") == 0.1 and math.isclose(r.remaining("q", 90), 4.0) and r.remaining("none", 5) is None
