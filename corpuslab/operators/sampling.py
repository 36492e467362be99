"""Deterministic samples: order by a hash, never by ``rand()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import hashing as H


def hash_rank(df: DataFrame, by: list[str], seed: str, id_col: str, name: str = "rank") -> DataFrame:
    """Rank of each row in the hash order of its stratum.

    Rows are ranked within (stratum, leading digits of the hash); counts of the smaller groups are added. So a stratum
    with a third of all rows is ranked by many tasks."""
    keyed = df.withColumn("_key", H.md5_order(seed, F.col(id_col))).withColumn("_group", F.left("_key", F.lit(3)))
    ahead = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*by, "_group").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_group").alias("_g"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(*by, "_group").orderBy("_key"))
    on = F.col("_group") == F.col("_g")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return keyed.withColumn("_own", own).join(counts, on).withColumn(name, F.col("_own") + F.col("_ahead")).select(*df.columns, name)


def range_group(df: DataFrame, id_col: str, groups: int = 1024) -> Column:
    """Number of the range of ids that a row lies in; ranges are equally wide and follow the ids' order."""
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return F.lit(0)
    return F.floor((F.col(id_col) - low) / (high - low + 1) * groups).cast("int")


def ordered_rank(df: DataFrame, by: list[str], id_col: str, name: str = "rank") -> DataFrame:
    """Dense rank of each row by a numeric id within its stratum, from 1.

    Rows are ranked within (stratum, range of ids) and the numbers of the ranges before are added, so a stratum with a
    third of all rows is ranked by many tasks."""
    keyed = df.withColumn("_group", range_group(df, id_col))
    ahead = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*by, "_group").agg(F.count_distinct(id_col).alias("_n"))
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_group").alias("_g"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    on = F.col("_group") == F.col("_g")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    own = F.dense_rank().over(Window.partitionBy(*by, "_group").orderBy(id_col))
    return keyed.withColumn("_own", own).join(counts, on).withColumn(name, F.col("_own") + F.col("_ahead")).select(*df.columns, name)


def tile(rank: Column, total: Column, tiles: int) -> Column:
    """Number (from 1) of the tile that a rank falls into; the first ones have one row more where the total leaves a rest."""
    size, rest = F.floor(total / tiles), total % tiles
    first = rest * (size + 1)
    return F.when(rank <= first, F.ceil(rank / (size + 1))).otherwise(rest + F.ceil((rank - first) / size)).cast("int")


def capped(df: DataFrame, by: str, n: int, seed: str, id_col: str, repeat: int = 1) -> DataFrame:
    """At most ``n`` rows of each stratum in hash order, each ``repeat`` times (``copy`` from 1).

    The rank filter is pushed below the shuffle as a group limit, so a large stratum sends ``n`` rows a task."""
    w = Window.partitionBy(by).orderBy(H.md5_order(seed, F.col(id_col)))
    out = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))


def share_of_stratum(df: DataFrame, by: list[str], share: float, seed: str, id_col: str) -> DataFrame:
    """``round(share * n)`` rows of each stratum in hash order."""
    limits = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.round(F.count(F.lit(1)) * share).alias("_limit"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return hash_rank(df, by, seed, id_col).join(limits, on).where(F.col("rank") <= F.col("_limit")).select(*df.columns, "rank")


def weighted_order(df: DataFrame, weight: Column, seed: str, id_col: str, by: str, n: int) -> DataFrame:
    """The first ``n`` of each stratum in weighted order without replacement: the largest ln(u) / weight come first."""
    key = F.log(H.md5_uniform(seed, F.col(id_col))) / weight
    w = Window.partitionBy(by).orderBy(F.desc("_key"), id_col)
    return df.withColumn("_key", key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_key")


def batches(df: DataFrame, size: int, seed: str, id_col: str, partition: str) -> DataFrame:
    """Review batches in hash order within each ``partition`` (``batch`` from 0)."""
    return hash_rank(df, [partition], seed, id_col, "_rank").withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank")


def passes(df: DataFrame, n: int, seed: str, id_col: str) -> DataFrame:
    """Endless shuffled passes as rows: every row once in each of ``n`` passes, each in an order of its own."""
    out = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("order_key", H.md5_order(seed, F.col("pass"), F.col(id_col)))
