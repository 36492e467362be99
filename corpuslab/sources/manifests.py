"""Tables that grow run by run, and chunk by chunk, where a job can be killed at any moment or run twice at once.

A run writes its files into a folder of its own. Only when all of them are there does it publish one manifest file, which
Spark's commit protocol lets appear whole or not at all. Readers go by the manifests: files of a killed run are never
seen, a chunk that two runs have written is taken from the one that was published first, and a rerun writes only
chunks that no manifest has.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "chunk string, run string, n_rows bigint, began timestamp, published timestamp"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, run, n_rows, began, published) of everything published under ``path``; empty if nothing is."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def winners(spark: SparkSession, path: str) -> DataFrame:
    """One run a chunk: the one that was published first (ties by its name)."""
    return manifests(spark, path).groupBy("chunk").agg(F.min_by("run", F.struct("published", "run")).alias("run"))


def _write(df: DataFrame, folder: str, chunk: str | None) -> None:
    (df.write.partitionBy(chunk) if chunk else df.write).parquet(folder)


def _announce(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifests")


def publish(df: DataFrame, path: str, chunk: str | None = None) -> int:
    """Write the chunks of ``df`` (values of the column ``chunk``; null is one too) that are not published yet; returns their rows.

    Without ``chunk`` the run is one chunk of its own, so every run adds its rows. A run without rows publishes nothing."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    (began,) = spark.range(1).select(F.current_timestamp()).first()
    if chunk:
        done = winners(spark, path).select(F.col("chunk").alias("_done"))
        df = df.join(done, F.col(f"`{chunk}`").cast("string").eqNullSafe(F.col("_done")), "left_anti")
    folder = f"{path}/runs/{run}"
    _write(df, folder, chunk)
    rows = spark.read.schema(df.schema).parquet(folder)
    name = F.col(f"`{chunk}`").cast("string") if chunk else F.lit(run)
    counted = rows.groupBy(name.alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"))
    counted = counted.select("chunk", F.lit(run).alias("run"), "n_rows", F.lit(began).alias("began"), F.current_timestamp().alias("published"))
    total = counted.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    if total:
        _announce(counted, path)
    return total


def published(spark: SparkSession, path: str, schema: str, chunk: str | None = None) -> DataFrame:
    """All published rows. The driver sees the names of the runs."""
    own = winners(spark, path)
    runs = sorted(r["run"] for r in own.select("run").distinct().collect())
    if not runs:
        return spark.createDataFrame([], schema)
    parts = []
    for run in runs:
        rows = spark.read.schema(schema).parquet(f"{path}/runs/{run}")
        if chunk:
            mine = own.where(F.col("run") == run).select(F.col("chunk").alias("_mine"))
            rows = rows.join(mine, F.col(f"`{chunk}`").cast("string").eqNullSafe(F.col("_mine")), "left_semi")
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def damaged(spark: SparkSession, path: str, schema: str, chunk: str) -> DataFrame:
    """(chunk, n_rows, n_found) of published chunks that do not have the rows their manifest tells of."""
    found = published(spark, path, schema, chunk).groupBy(F.col(f"`{chunk}`").cast("string").alias("_c")).agg(F.count(F.lit(1)).alias("n_found"))
    wanted = manifests(spark, path).join(winners(spark, path), ["chunk", "run"])
    both = wanted.join(found, F.col("chunk").eqNullSafe(F.col("_c")), "left")
    return both.select("chunk", "n_rows", F.coalesce("n_found", F.lit(0)).alias("n_found")).where("n_rows <> n_found")


def cached(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A cache that runs have filled: one row a key. Runs that overlapped in time may both have computed a key; the first published has it."""
    rows = manifests(spark, path).select("run", "began", "published").distinct()
    runs = sorted(rows.collect(), key=lambda r: (r["published"], r["run"]))
    if not runs:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{path}/runs/{r['run']}").withColumn("_no", F.lit(k)) for k, r in enumerate(runs)]
    table = reduce(DataFrame.unionByName, parts)
    if any(a["published"] >= b["began"] for a, b in zip(runs, runs[1:], strict=False)):
        columns = [F.col(f"`{c}`") for c in table.columns if c != "_no"]
        table = table.groupBy(key).agg(F.min_by(F.struct(*columns), "_no").alias("_row")).select("_row.*")
    return table.drop("_no")
