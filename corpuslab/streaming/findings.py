"""Findings that arrive stage by stage: stateful upsert by place, late versions dropped.

A place is (doc_id, start, end). The state of a place is the finding of the highest rank that has come; a finding for an
older version of its document is late and dropped; a decided place is final.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["doc_id", "start", "end"]
STATE = "rank int, rule string, fix string, decided boolean, version int"
OUT = f"doc_id bigint, start int, end int, {STATE}"


def step(state: tuple | None, row: tuple) -> tuple:
    """State after one finding (rank, rule, fix, decided, version): a newer version starts anew, the higher rank wins."""
    if state is None or row[4] > state[4]:
        return row
    if row[4] < state[4] or state[3]:
        return state
    return row if row[3] or (row[0], state[1]) > (state[0], row[1]) else state


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int = 0) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # nothing came for a place: it is forgotten
        state.remove()
        return
    now = state.get if state.exists else None
    for frame in frames:
        for row in frame.sort_values(["version", "arrival"])[["rank", "rule", "fix", "decided", "version"]].itertuples(index=False):
            now = step(now, tuple(row))
    state.update(now)
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame([[*key, *now]], columns=[c.split()[0] for c in OUT.split(", ")])


def upserted(stream: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The stream of changed places. ``idle_ms``: the state of a place for which nothing came so long is dropped (0: never)."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*KEYS).applyInPandasWithState(partial(_update, idle_ms=idle_ms), OUT, STATE, "update", timeout)


def upserted_batch(findings: DataFrame) -> DataFrame:
    """The same result from a finished table: newest version, then decided, then rank."""
    newest = Window.partitionBy(*KEYS)
    rows = findings.withColumn("_v", F.max("version").over(newest)).where("version = _v")
    order = newest.orderBy(F.desc("decided"), F.when(F.col("decided"), F.col("arrival")), F.desc("rank"), "rule")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*KEYS, "rank", "rule", "fix", "decided", "version")


def current_only(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Findings of the current version of their document."""
    return findings.join(documents.select("doc_id", F.col("version").alias("_v")), "doc_id").where("version = _v").drop("_v")
