"""Stages of models over rows: each stage loads its model once a task and only if there are rows, and yields findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.sources.sinks import cache_fill

FINDINGS = "stage string, idx bigint, start int, end int, level string, rule string, fix string, p double"
Finding = tuple[int, int, str, str, str | None, float | None]


@dataclass(frozen=True)
class Stage:
    """``load`` makes a function from a text to its findings (start, end, level, rule, fix, p); ``cost`` is seconds a row."""

    name: str
    cost: float
    load: Callable[[], Callable[[str], Iterable[Finding]]]


def run_stage(rows: DataFrame, stage: Stage, size: int = 64) -> DataFrame:
    """Findings of one stage over rows (idx, text). Rows of about the same length are neighbours, as batches want them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            if len(frame) == 0:
                continue
            model = model or stage.load()
            out = [(stage.name, i, *f) for i, t in zip(frame["idx"], frame["text"], strict=True) if t is not None for f in model(t)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return rows.select("idx", "text").sortWithinPartitions(F.length("text")).mapInPandas(run, FINDINGS)


def run_stages(rows: DataFrame, stages: list[Stage], start: tuple[str, int] | None = None) -> DataFrame:
    """All stages in their order; ``start`` = (stage, idx) resumes there: earlier stages and smaller rows of it are done."""
    names = [s.name for s in stages]
    if len(set(names)) != len(names):
        raise ValueError("stages need different names")
    if start and start[0] not in names:
        raise ValueError(f"unknown stage {start[0]!r}; known: {', '.join(names)}")
    first = names.index(start[0]) if start else 0
    out = None
    for k, stage in enumerate(stages[first:], first):
        part = run_stage(rows.where(F.col("idx") >= start[1]) if start and k == first else rows, stage)
        out = part if out is None else out.union(part)
    return out


def plan(rows: DataFrame, stages: list[Stage]) -> DataFrame:
    """(stage, steps, seconds): what a run will cost."""
    spark = rows.sparkSession
    costs = spark.createDataFrame([(k, s.name, s.cost) for k, s in enumerate(stages)], "place int, stage string, cost double")
    return costs.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("steps")))).select("place", "stage", "steps", (F.col("steps") * F.col("cost")).alias("seconds"))


def predictions(rows: DataFrame, key: str, text: str, path: str, load: Callable[[], Callable[[str], float]]) -> DataFrame:
    """Cached predictions (key, p): only texts that the cache lacks are computed, each once."""

    def compute(missing: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                if len(frame):
                    model = model or load()
                    yield pd.DataFrame({key: frame[key], "p": [model(t) for t in frame[text]]})

        schema = missing.select(key, F.lit(0.0).alias("p")).schema
        return missing.select(key, text).mapInPandas(run, schema)

    return cache_fill(rows, key, path, compute)


def in_two_sinks(stream: DataFrame, first: str, second: str, condition: str, checkpoint: str):
    """A stream written twice: all rows to ``first``, those that meet ``condition`` to ``second``; both in the same batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(first)
        batch.where(condition).withColumn("batch", F.lit(number)).write.mode("append").parquet(second)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
