"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are dealt into blocks by a hash. How many rows of a block go to each shard is not left to chance per row: the
whole blocks-by-shards matrix is drawn from the multivariate hypergeometric distribution that a uniform permutation of
all rows would give, so every shard has exactly its size. Each block is then permuted locally and cut by its row of the
matrix, the rows are exchanged, and each shard is permuted again, which gives the slots. Keys of both permutations are
hashes of the row, so a lost task repeats the same decision, and a rerun gives the same shards.

Only the block counts (``blocks`` numbers) reach the driver; all rows stay in DataFrame operations.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.staging import free_names, parallelism

#: Rows that a block should hold, and cells that the matrix, which the driver draws, has at most.
BLOCK_ROWS, MATRIX_CELLS = 50_000, 1 << 20
#: Rows by which a block may exceed four times the mean before repeated rows are looked for.
CROWD = 10_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Draw the number of good ones among ``draws`` without replacement, by inverting the mass around its mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = (draws * (good / total) * (bad / total) * max(0.0, (total - draws) / max(1, total - 1))) ** 0.5
    reach = int(14 * spread) + 30
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(mode, last, dtype=float)
    up = np.cumprod((good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1)))
    k = np.arange(mode, first, -1, dtype=float)
    down = np.cumprod(k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1)))
    mass = np.concatenate([down[::-1], [1.0], up])
    at = np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), side="right")
    return int(first + min(at, len(mass) - 1))


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard; shard totals differ by one at most, block totals are ``block_sizes``."""
    total, rng = sum(block_sizes), random.Random(seed)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for size in block_sizes:
        row, rest, draws = [], sum(left), size
        for s in range(n_shards):
            rest -= left[s]
            take = hypergeometric(rng, left[s], rest, draws)
            row.append(take)
            draws -= take
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A few rows as a DataFrame without leaving SQL: a JSON literal, parsed."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def shard(docs: DataFrame, n_shards: int = 8, keys: list[str] | None = None, blocks: int | None = None, seed: int = 17) -> DataFrame:
    """Add ``shard`` (int, from 0) and ``slot`` (bigint, gapless from 0 within the shard) to every row.

    Shard sizes differ by one at most. ``keys`` (default: every column that can be hashed) identify a row; rows equal
    in all keys are numbered and placed independently; without ``keys``, a row that is repeated so often that its block
    stands out is counted and dealt copy by copy over all blocks. Nulls, empty and very long texts are hashed as they are; an empty table gives an
    empty result; existing columns named ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    whole_rows = keys is None and not any("map<" in kind or kind in ("variant", "void") for _, kind in docs.dtypes)
    keys = keys or [c for c, kind in docs.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    blocks = max(1, min(blocks or max(64, parallelism(spark), docs.count() // BLOCK_ROWS), MATRIX_CELLS // n_shards))
    block, row, copy, rank, cuts, group, within, base = free_names(docs, "block", "row", "copy", "rank", "cuts", "group", "within", "base")

    def draw(salt: int) -> Column:
        return F.xxhash64(F.lit(seed * 1000 + salt), row, copy)

    # How rows come into blocks does not matter for a uniform shuffle; a hash of the row deals them evenly, and again alike.
    dealt = docs.withColumn(row, F.xxhash64(F.lit(seed), *[f"`{c}`" for c in keys])).withColumn(block, F.pmod(row, F.lit(blocks)).cast("int"))
    counted = {r[0]: r[1] for r in dealt.groupBy(block).count().collect()}
    # Equal rows are numbered within their block, so that each gets a place of its own.
    number = lambda df: df.repartition(block).withColumn(copy, F.row_number().over(Window.partitionBy(block, row).orderBy(row)))
    numbered, mean = number(dealt), sum(counted.values()) / blocks
    large = [b for b, n in counted.items() if n > 4 * mean + CROWD]
    if large and whole_rows:
        often = dealt.where(F.col(block).isin(large)).groupBy(row).count().where(F.col("count") > mean + CROWD / 2)
        hot = [r[0] for r in often.collect()]  # fewer than there are blocks
        if hot:
            many = dealt.where(F.col(row).isin(hot)).groupBy(*[f"`{c}`" for c in docs.columns], row).agg(F.count(F.lit(1)).cast("int").alias(rank))
            many = many.withColumn(copy, F.explode(F.sequence(F.lit(1), rank))).drop(rank).withColumn(block, F.pmod(F.xxhash64(row, copy), F.lit(blocks)).cast("int"))
            numbered = number(dealt.where(~F.col(row).isin(hot))).unionByName(many)
            counted = {r[0]: r[1] for r in numbered.groupBy(block).count().collect()}
    sizes = [counted.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(sizes, n_shards, seed)
    edges = small_table(spark, [{"b": b, "c": np.cumsum(line).tolist()} for b, line in enumerate(matrix)], "b int, c array<bigint>")
    edges = edges.select(F.col("b").alias(block), F.col("c").alias(cuts))

    local = Window.partitionBy(block).orderBy(draw(2), draw(3))
    placed = numbered.withColumn(rank, F.row_number().over(local) - 1).join(F.broadcast(edges), block)
    placed = placed.withColumn("shard", F.expr(f"size(filter({cuts}, c -> c <= {rank}))").cast("int")).drop(rank, cuts, block)

    # The second permutation: each shard is cut into hash groups, whose counts give the first slot of each group.
    placed = placed.withColumn(group, F.pmod(draw(4), F.lit(blocks)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", group).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(base))
    own = Window.partitionBy("shard", group).orderBy(draw(5), draw(6))
    out = placed.withColumn(within, F.row_number().over(own) - 1).join(F.broadcast(starts), ["shard", group])
    return out.withColumn("slot", F.col(within) + F.col(base)).select(*docs.columns, "shard", "slot")


def query_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the law ``rows``; a null text has no bytes and the checksum of none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
