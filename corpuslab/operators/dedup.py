"""Exact and prioritised deduplication, overlap with evaluation text, and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import hashing as H
from corpuslab.functions import text as T


def first_wins(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key. One aggregate with map-side combination, no window: a hot key costs a row a task."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    picked = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys that occur more than once, with their first id and their number."""
    return df.groupBy(key.alias("key")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def overlapping(df: DataFrame, key: Column, known: DataFrame, known_key: Column) -> DataFrame:
    """Rows whose key is among the known ones (left semi join on distinct keys)."""
    return df.withColumn("_k", key).join(known.select(known_key.alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def without_overlap(df: DataFrame, key: Column, known: DataFrame, known_key: Column) -> DataFrame:
    """Rows whose key is not among the known ones (left anti join on distinct keys)."""
    return df.withColumn("_k", key).join(known.select(known_key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def prefix_guard(text: Column, n: int = 30) -> Column:
    """Key of the near-duplicate guard: the first characters of the match key, null if it is shorter."""
    key = T.match_key(text)
    return F.when(F.length(key) >= n, F.substring(key, 1, n))


def split_name(key: Column, dev: int = 10, test: int = 20) -> Column:
    """Document-disjoint split by the hash bucket of the document."""
    bucket = H.md5_bucket(key)
    return F.when(bucket < dev, "dev").when(bucket < test, "test").otherwise("train")


def cascade(df: DataFrame, key: Column, known: list[tuple[str, DataFrame]], *order: Column) -> DataFrame:
    """Rows with ``reason``: the first known set that holds the key, ``duplicate`` for all but the first row of a key, or ``kept``."""
    hashed = lambda c: F.unhex(F.md5(c))  # 16 bytes move and are compared, not texts
    out = df.withColumn("_k", hashed(key))
    reasons = []
    for i, (name, keys) in enumerate(known):
        out = out.join(keys.select(hashed(F.col(keys.columns[0])).alias("_k"), F.lit(True).alias(f"_in{i}")).distinct(), "_k", "left")
        reasons.append(F.when(F.col(f"_in{i}"), name))
    # The first row of a key by an aggregate, not a window: a hot key costs a row a task. Only keys that repeat are joined back.
    first = df.select(hashed(key).alias("_k"), F.struct(*order).alias("_o")).groupBy("_k").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    out = out.join(first, "_k", "left").withColumn("_later", F.coalesce(F.struct(*order) != F.col("_first"), F.lit(False)))
    return out.withColumn("reason", F.coalesce(*reasons, F.when(F.col("_later"), "duplicate"), F.lit("kept"))).drop("_k", "_later", "_first", *[f"_in{i}" for i in range(len(known))])
