"""Long runs that can be stopped, resumed and timed: stages over batches of rows, and streams.

A run of stages goes stage by stage, and in a stage batch by batch (a batch is a range of row numbers). Each batch is
published whole, so a stopped or killed run loses at most the batch in hand, and a run over the same path goes on where
the one before has ended. Rates and loading times are measured on the way; what is left is estimated from them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from corpuslab.operators import spans
from corpuslab.operators.rules import LEVELS
from corpuslab.operators.stages import FINDINGS, Stage, run_stage
from corpuslab.sources import manifests

#: Seconds that a stage's model is taken to need before any has been loaded, and the cost below which a stage has none.
DEFAULT_LOAD, NO_MODEL = 3.0, 0.01
CHUNKED = f"{FINDINGS}, batch string"


@dataclass
class Progress:
    """Steps of stages: ``total`` rows each, ``cost`` seconds a row as planned, ``passes`` models one after another."""

    total: int
    cost: dict[str, float]
    passes: dict[str, int] = field(default_factory=dict)
    clock: Callable[[], float] = time.monotonic
    done: dict[str, int] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    _first: dict[str, tuple[float, int, float]] = field(default_factory=dict)  # when the first steps ended, how many, and when they began
    _last: dict[str, float] = field(default_factory=dict)
    _event: float | None = None

    def start(self) -> None:
        self._event = self.clock()

    def skip(self, stage: str, rows: int) -> None:
        """Rows of a stage that an earlier run has done."""
        self.skipped[stage] = min(rows, self.total)

    def stepped(self, stage: str, rows: int = 1) -> None:
        """Some rows of a stage are done, in one of its passes."""
        now = self.clock()
        if stage not in self._first and rows:
            self._first[stage] = (now, rows, now if self._event is None else self._event)
        self.done[stage] = self.done.get(stage, 0) + rows
        self._last[stage] = self._event = now

    def _size(self, stage: str) -> int:
        return self.total * self.passes.get(stage, 1)

    def _finished(self, stage: str) -> int:
        return self.done.get(stage, 0) + self.skipped.get(stage, 0) * self.passes.get(stage, 1)

    def fraction(self) -> float:
        """Share of the planned cost that is done."""
        whole = sum(c * self._size(s) for s, c in self.cost.items())
        return min(1.0, sum(c * self._finished(s) for s, c in self.cost.items()) / whole) if whole > 0 else 1.0

    def rates(self) -> dict[str, float]:
        """Measured seconds a row, of stages with more than their first steps."""
        return {s: (self._last[s] - at) / (self.done[s] - rows) for s, (at, rows, _) in self._first.items() if self.done[s] > rows}

    def remaining(self) -> float | None:
        """Seconds left: measured rates, for other stages the planned cost at the measured speed, and models still to be
        loaded; None before any rate is measured."""
        rates = self.rates()
        if not rates:
            return None
        heavy = [s for s in rates if self.cost[s] >= NO_MODEL]
        planned = sum(self.cost[s] * self.done[s] for s in heavy)
        speed = sum(rates[s] * self.done[s] for s in heavy) / planned if planned else 1.0
        loads = [max(0.0, self._first[s][0] - self._first[s][2] - rates[s] * self._first[s][1]) for s in heavy]
        load = sum(loads) / len(loads) if loads else DEFAULT_LOAD
        out = 0.0
        for s, cost in self.cost.items():
            left = self._size(s) - self._finished(s)
            if left > 0:
                per_pass = max(1, self.total - self.skipped.get(s, 0))
                waiting = self.passes.get(s, 1) - -(-self.done.get(s, 0) // per_pass)  # models whose pass has not begun
                out += left * rates.get(s, cost * speed) + (load * max(0, waiting) if s in rates or cost >= NO_MODEL else 0.0)
        return out


def run_controlled(rows: DataFrame, stages: list[Stage], path: str, batch: int = 10_000, should_stop: Callable[[], bool] = bool, progress: Progress | None = None) -> bool:
    """Run stages over rows (idx, text), ``batch`` row numbers at a time, into ``path``; whether all is done.

    ``should_stop`` is asked before each batch. What an earlier run has published under ``path`` is not computed again.
    Row numbers are whole and not negative; gaps in them are harmless. :func:`results` reads the findings."""
    spark = rows.sparkSession
    done = {r["chunk"] for r in manifests.winners(spark, f"{path}/batches").select("chunk").collect()}
    last, total = rows.agg(F.coalesce(F.max("idx"), F.lit(-1)), F.count(F.lit(1))).first()
    sizes = {r["b"]: r["n"] for r in rows.groupBy(F.floor(F.col("idx") / batch).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    progress = progress or Progress(total, {s.name: s.cost for s in stages})
    progress.total = total
    for stage in stages:
        progress.skip(stage.name, sum(n for b, n in sizes.items() if f"{stage.name}/{b}" in done))
    progress.start()
    for stage in stages:
        for b in range(last // batch + 1 if last >= 0 else 0):
            name = f"{stage.name}/{b}"
            if name in done or b not in sizes:
                continue
            if should_stop():
                return False
            part = rows.where((F.col("idx") >= b * batch) & (F.col("idx") < (b + 1) * batch))
            found = run_stage(part, stage).withColumn("batch", F.lit(name))
            manifests.publish(found, f"{path}/findings", "batch")
            # A batch without findings is done all the same: its name is published apart, after them.
            manifests.publish(spark.range(1).select(F.lit(name).alias("name"), F.lit(sizes[b]).alias("n_rows")), f"{path}/batches", "name")
            progress.stepped(stage.name, sizes[b])
    return True


def results(rows: DataFrame, path: str) -> DataFrame:
    """Findings of all finished batches under ``path``, of the rows' session."""
    return manifests.published(rows.sparkSession, f"{path}/findings", CHUNKED, "batch").drop("batch")


def checked(rows: DataFrame, stages: list[Stage], path: str, **options) -> DataFrame | None:
    """The whole check in one call: all stages over rows (idx, text), and the findings of each row merged by level: (idx, start,
    end, rank, rule, fix). Of what overlaps the surer level stays, then the earlier stage's. None if it was stopped; a later
    call with the same path goes on. Hidden levels (candidate) take no part; other options are those of :func:`run_controlled`."""
    if not run_controlled(rows, stages, path, **options):
        return None
    level = F.create_map(*[x for name, k in LEVELS.items() for x in (F.lit(name), F.lit(k))])[F.col("level")]
    place = F.create_map(*[x for k, s in enumerate(stages) for x in (F.lit(s.name), F.lit(len(stages) - k))])[F.col("stage")]
    found = results(rows, path).withColumn("rank", (level * (len(stages) + 1) + place).cast("int")).where("rank is not null")
    one = F.struct("start", "end", "rank", "rule", "fix")
    merged_ = spans.merged(found.groupBy("idx").agg(F.collect_list(one).alias("found")), "found").select("idx", F.explode("found").alias("f")).select("idx", "f.*")
    return merged_.withColumn("rank", F.floor(F.col("rank") / (len(stages) + 1)).cast("int"))


class Rates(StreamingQueryListener):
    """Listens to the streams of a session: batches, rows and seconds of each query, by its id."""

    def __init__(self) -> None:
        self.batches: dict[str, list[tuple[int, int, float]]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.batches.setdefault(str(event.id), [])

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.setdefault(str(p.id), []).append((p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.id))

    def rate(self, query: str) -> float | None:
        """Seconds a row, without the first batch (it loads and compiles); None before a second one."""
        own = [x for x in self.batches.get(query, []) if x[1]]
        rows = sum(n for _, n, _ in own[1:])
        return sum(s for _, _, s in own[1:]) / rows if rows else None

    def remaining(self, query: str, rows: int) -> float | None:
        """Seconds for the rest of ``rows``."""
        rate = self.rate(query)
        return None if rate is None else rate * max(0, rows - sum(n for _, n, _ in self.batches[query]))


def started(stream: DataFrame, path: str, checkpoint: str, should_stop: Callable[[], bool] = bool, mode: str = "append") -> StreamingQuery:
    """Write a stream to ``path`` batch by batch until its source is empty or ``should_stop`` says so, which is asked before each batch.

    A batch is published whole under its number. A run with the same checkpoint goes on with the batch that was not
    written: Spark offers it again, under the same number, so no row is lost and none comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        if should_stop():
            raise Stopped
        manifests.publish(batch.withColumn("_batch", F.lit(number)), path, "_batch")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Stopped(Exception):
    """A stream was asked to stop."""


def finished(query: StreamingQuery) -> bool:
    """Wait for a stream of :func:`started`: True if its source is empty, False if it was stopped; other failures are raised."""
    try:
        query.awaitTermination()
    except Exception as error:
        if Stopped.__name__ not in str(error):
            raise
        return False
    return True
