"""A corpus pipeline of the training-data operators: five stages over the documents.

Each stage is written as Parquet to the shared folder and read again by the next one. All but the last return the
columns of the documents they were given; the last adds the shard and the slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontamination, mixing, near_dedup, quality, sharding
from corpuslab.llm.staging import discard, free_names, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more); a third of the labels is held out from learning.

    Null and empty texts are scored as one empty passage; repeated rows get the same score; ties at 0.5 stay; an empty table
    stays empty; without labels every score is 0.5 and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = quality.learn(docs, labels)
    (score,) = free_names(docs, "quality_score")
    scored = quality.classify(docs, model, carry=docs.columns, column=score)
    return scored.where(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Documents without words have no shingles and stay; of rows with the same id one stays as often as it is there."""
    found = near_dedup.near_duplicates(docs)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item. Null and empty texts have none and stay; repeated rows are
    each judged; an empty benchmark keeps all."""
    (hits,) = free_names(docs, "n_hit")
    out = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return out.where(F.col(hits) == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; a document may come twice or not at all. Null and empty texts have no words
    and are never taken; a null source is one of its own, the last; repeated rows are taken or left together."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards in a uniformly random order, sizes at most one apart. Nulls are hashed like any value; repeated rows get
    places of their own; columns named shard or slot are replaced; an empty table stays empty."""
    return sharding.shard(docs, 8)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A learned score, similarity search and random draws have no SQL twin; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # the next stage is written
            discard(before)
        before = docs
    return docs
