"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document of a source should be taken ``e`` times on average, where ``e``
follows its importance and the factor that brings the source to its target. ``floor(e)`` whole copies are certain. The
fraction that is left is an inclusion probability p, and the documents are ranked by their random odds divided by their
inclusion odds, (u/(1-u)) / (p/(1-p)). The first ones in this order, as many words as the source still lacks, get one
more copy: a sample of fixed size with unequal probabilities. The next one in this order closes the sample if that brings
the sum nearer to the words still open.

The order is never sorted as a whole: the rank is cut into buckets, sums by bucket locate the boundary of each source,
and only the rows of the boundary bucket are ordered. So a source with a third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.sharding import small_table
from corpuslab.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"


def allocated(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Sources (source, z) with ``t``: targets in proportion to the weights, which repeat in code point order (null last);
    none above ``cap`` times its size, the excess goes to the others.

    The driver sees only sums: how many sources a task has sorted, and in each round the sizes of those that are full."""
    spark = sizes.sparkSession
    order = F.monotonically_increasing_id()
    placed = staged(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("id", order), "mix-order")
    part = F.shiftright("id", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    offsets = [{"part": p, "before": sum(n for q, n in counts if q < p)} for p, _ in counts]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.withColumn("part", part).join(F.broadcast(small_table(spark, offsets, "part bigint, before bigint")), "part")
    weighed = staged(weighed.select("source", "z", weight.alias("weight")), "mix-weights")
    total, level = share * (weighed.agg(F.sum("z")).first()[0] or 0), None
    while True:  # the level rises until no source is filled above its cap
        full = F.lit(False) if level is None else F.col("weight") * level > cap * F.col("z")
        used, free = weighed.agg(F.sum(F.when(full, cap * F.col("z")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        now = (total - used) / free if free else float("inf")
        if level is not None and not now > level:
            break
        level = now
        if not free:
            break
    top = cap * F.col("z")
    return weighed.select("source", "z", top.cast("double").alias("t") if level == float("inf") else F.least(top, F.col("weight") * level).alias("t"))


def importance(size_class: int) -> float:
    """Short fragments count for less; from some dozens of words on the importance is near 1."""
    return 2.0**size_class / (2.0 + 2.0**size_class)


def expected_copies(class_words: dict[int, int], target: float, cap: float) -> dict[int, float]:
    """Copies by size class: ``min(cap, c * importance)`` with the one c that gives ``target`` words."""
    low, high = 0.0, cap / min(map(importance, class_words), default=1.0)
    for _ in range(200):
        c = (low + high) / 2
        if sum(w * min(cap, c * importance(k)) for k, w in class_words.items()) < target:
            low = c
        else:
            high = c
    return {k: min(cap, high * importance(k)) for k in class_words}


def _planned(cap: float):
    """(source, z, t, classes) -> (s, k, z, t, w, p, o): by size class the certain copies, the chance of one more, and the words still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = {c["mix_class"]: c["words"] for c in row["classes"]}
                expect = expected_copies(words, row["t"], cap)
                whole = {k: int(e + 1e-9) for k, e in expect.items()}
                left = max(0.0, row["t"] - sum(words[k] * whole[k] for k in expect))
                out += [(row["source"], k, row["z"], row["t"], whole[k], e - whole[k] if e - whole[k] > 1e-9 else 0.0, left) for k, e in expect.items()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], list("skztwpo"))

    return run


def sized(docs: DataFrame, text: str = "text", row_key: tuple[str, ...] = ("doc_id", "text"), seed: int = 29) -> DataFrame:
    """Add ``mix_size`` (words of the text, null: 0), ``mix_class`` (binary order of the size) and ``mix_draw`` (the row's random number)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"mix_size": size, "mix_draw": F.xxhash64(F.lit(seed), *[F.col(c) for c in row_key])}).withColumn("mix_class", F.ceil(F.log2(F.col("mix_size") + 1)).cast("int"))


def _uniform(draw: Column) -> Column:
    return (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def copies(rows: DataFrame, light: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """Add ``mix_source_size``, ``mix_target`` and ``mix_copies`` to ``rows``.

    ``rows`` and ``light`` both come from :func:`sized` over the same documents and have a ``source``; ``light`` is a
    written table without the text. Sources are weighed in code point order, null last. Rows equal in source and draw
    (repeated rows) are taken or left together. Empty tables give an empty result; a size of 0 is never taken.
    """
    by_class = staged(light.groupBy("source", "mix_class").agg(F.sum("mix_size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-classes")
    targets = allocated(by_class.groupBy("source").agg(F.sum("words").alias("z")), weights, share, cap)
    classes = by_class.groupBy("source").agg(F.collect_list(F.struct("mix_class", "words")).alias("classes"))  # some dozens at most
    both = targets.join(classes.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).select("source", "z", "t", "classes")
    table = staged(both.mapInArrow(_planned(cap), "s string, k int, z bigint, t double, w int, p double, o double").select(*[F.col(c).alias(f"mix_plan_{c}") for c in "skztwpo"]), "mix-plan")
    largest = by_class.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = min(1 << 20, max(1 << 10, largest // 500))

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    def ranked(df: DataFrame) -> DataFrame:
        u, p = _uniform(F.col("mix_draw")), F.col("mix_plan_p")
        odds = u * (1 - p) / (u * (1 - p) + (1 - u) * p)  # q / (1 + q) of the Pareto rank q: the same order, within 0 and 1
        joined = df.join(table, same("source", "mix_plan_s") & (F.col("mix_class") == F.col("mix_plan_k")))
        joined = joined.withColumn("mix_odds", F.when((p > 0) & (F.col("mix_size") > 0), odds))
        return joined.withColumn("mix_bucket", F.least(F.floor(F.col("mix_odds") * buckets), F.lit(buckets - 1)).cast("int"))

    chance = ranked(light).where("mix_odds is not null").select(F.col("mix_plan_s").alias("s"), F.col("mix_plan_o").alias("o"), F.col("mix_odds").alias("odds"), F.col("mix_bucket").alias("bucket"), "mix_draw", "mix_size")
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = chance.groupBy("s", "bucket").agg(F.sum("mix_size").alias("words"), F.first("o").alias("o"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    edge = sums.where("before <= o and before + words > o").select(F.col("s").alias("mix_edge_s"), F.col("bucket").alias("mix_edge"), "before")
    edge = staged(edge, "mix-edge")  # a row a source at most
    # Within the boundary bucket: the exact order, equal rows as one unit.
    unit = chance.join(edge, same("s", "mix_edge_s") & (F.col("bucket") == F.col("mix_edge")))
    unit = unit.groupBy("s", "odds", "mix_draw").agg(F.sum("mix_size").alias("words"), F.first("before").alias("before"), F.first("o").alias("o"))
    upto = Window.partitionBy("s").orderBy("odds", "mix_draw").rowsBetween(Window.unboundedPreceding, 0)
    unit = unit.withColumn("upto", F.col("before") + F.sum("words").over(upto))
    # The one that passes the words still open counts if it ends nearer to them than its forerunner.
    nearer = "upto <= o or (upto - words <= o and upto - o < o - (upto - words))"
    extra = staged(unit.where(nearer).select(F.col("s").alias("mix_taken_s"), F.col("mix_draw").alias("mix_taken_draw")), "mix-taken")

    out = ranked(rows).join(edge.select("mix_edge_s", "mix_edge"), same("source", "mix_edge_s"), "left")
    out = out.join(extra, same("source", "mix_taken_s") & (F.col("mix_draw") == F.col("mix_taken_draw")), "left")
    none = F.when(F.col("mix_plan_o") > 0, F.lit(buckets)).otherwise(F.lit(0))
    before_edge = F.col("mix_odds").isNotNull() & (F.col("mix_bucket") < F.coalesce(F.col("mix_edge"), none))
    more = (before_edge | F.col("mix_taken_draw").isNotNull()).cast("int")
    counted = F.when(F.col("mix_size") > 0, F.col("mix_plan_w") + more).otherwise(0)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("mix_plan_z").alias("mix_source_size"), F.col("mix_plan_t").alias("mix_target"), counted.alias("mix_copies"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0, seed: int = 29) -> DataFrame:
    """The mixed corpus: every document repeated as often as the mix takes it, with the columns it had."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[f"`{c}`" for c in docs.columns]).alias("mix_row"))  # no name of the documents clashes
    rows = sized(packed, seed=seed).drop("doc_id", "text")
    light = staged(rows.select("source", "mix_size", "mix_class", "mix_draw"), "mix-light")
    return copies(rows, light, share, weights, cap).where("mix_copies > 0").withColumn("mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("mix_row.*")


def query_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them (0: left out)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = staged(sized(docs).select("doc_id", "source", "mix_size", "mix_class", "mix_draw"), "mix-light")
    out = copies(light, light)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"))
