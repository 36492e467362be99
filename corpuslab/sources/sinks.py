"""Sinks. All go through Spark's commit protocol: a file appears whole or not at all. Where a job may be killed between
files, or run twice at once, ``manifests`` publishes whole chunks and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.sources import manifests


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def frequency_list(vocabulary: DataFrame, path: str) -> None:
    """Tab-separated words, most frequent first, ties by the word."""
    vocabulary.orderBy(F.desc("n"), "word").select("word", "n").write.csv(path, sep="\t", quote="")


def word_list(words: DataFrame, path: str, header: str) -> None:
    """One word a line below a comment line."""
    spark = words.sparkSession
    head = spark.range(1).select(F.lit(0).alias("k"), F.lit(f"# {header}").alias("value"))
    body = words.select(F.lit(1).alias("k"), F.col("word").alias("value"))
    head.union(body).orderBy("k", "value").select("value").write.text(path)


def chunks(df: DataFrame, path: str, chunk: str) -> None:
    """One folder a chunk; only chunks that are not there yet are written, so a rerun resumes. A chunk counts as there when
    it has a file: after a kill in the middle of a commit it may lack others (``manifests.publish`` has no such gap)."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if there:
        done = spark.read.parquet(path).select(chunk).distinct()
        df = df.join(done, chunk, "left_anti")
    df.write.mode("append").partitionBy(chunk).parquet(path)


def cache_fill(wanted: DataFrame, key: str, path: str, compute) -> DataFrame:
    """Prediction cache: rows of ``wanted`` whose key is not cached are computed and published; returns the cache.

    A killed run leaves nothing that a reader sees, and a key that two runs compute at once is in the cache once."""
    spark = wanted.sparkSession
    known = manifests.manifests(spark, path).select("run").distinct().collect()
    for r in known:
        wanted = wanted.join(spark.read.parquet(f"{path}/runs/{r['run']}").select(key), key, "left_anti")
    computed = compute(wanted.dropDuplicates([key]))
    manifests.publish(computed, path)
    return manifests.cached(spark, path, computed.schema, key)
