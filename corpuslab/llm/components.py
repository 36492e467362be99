"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.staging import replaced, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected ``edges`` (a, b), a != b; minima combine before the shuffle, so a hub costs no task its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["u"]).drop("u")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, name: str = "components", most_steps: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Loops and repeated edges are harmless; an empty input gives an empty result. Each step is written to the shared
    folder, so lineage stays short and a lost executor repeats one step at most.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(most_steps):
        edges = replaced(edges, staged(_star(_star(edges, True), False), name))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))
