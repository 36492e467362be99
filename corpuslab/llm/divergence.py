"""How far the sources of a language differ in their words: all pairs of groups by two-dimensional tiling.

Term counts are aggregated once. Each group's counts become one packed vector of smoothed shares per vocabulary chunk.
The groups of a language are cut into blocks, and each block's vectors are replicated to the tiles of its row and column:
a tile is one pair of blocks. A tile reads its vectors chunk after chunk and adds each chunk's part to the matrix of its
pairs, so memory holds two blocks of one chunk, whatever the size of the vocabulary and the number of groups.

All numbers are integers: shares are parts of 10^9, and a pair's value is the sum of floor((p-q)^2 / (p+q)) over terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.staging import discard, parallelism, staged

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
SCALE = 1_000_000_000
#: Characters of a piece of a long text, and terms that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 400_000
#: Groups of a block, and terms that a vocabulary chunk has about.
BLOCK, CHUNK = 32, 4096


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs): counted together until ``HELD`` terms are held, then passed on."""
    term, gap = re.compile(TERM), re.compile(GAP)
    counts: dict[tuple[str, str], tuple[Counter[str], Counter[str]]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            rows = pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            for first in range(0, len(rows), 1 << 16):
                yield rows.slice(first, 1 << 16)
        counts.clear()

    for batch in batches:
        held = 0
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.ascii_lower(batch.column(2)), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            text, at, seen = text.as_py(), 0, set()
            while at < len(text):  # a long text in pieces, cut between terms
                cut = gap.search(text, at + PIECE)
                end = cut.start() if cut else len(text)
                terms = term.findall(text, at, end)
                n.update(terms)
                seen.update(terms)
                at = end
            docs.update(seen)
            held += len(seen)
            if held > HELD // 16:
                held = 0
                if sum(len(x) for x, _ in counts.values()) > HELD:
                    yield from passed()
    yield from passed()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; ``docs`` has lang, source, text, no nulls."""
    partial = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exactly; null if there is no term at all."""
    wide = lambda c: c.cast("decimal(38,0)")
    top, under = wide(F.lit(SCALE)) * wide(n + 2), wide(total + 2 * v)
    return F.when(v > 0, F.call_function("div", top.cast("decimal(38,0)"), under) + 1).cast("long")


def _tiles(block: int):
    """Rows of (lang, x, y, chunk, side, member, width, absent, at, p), sorted -> (lang, x, y, i, j, value): one pass over
    all tiles of a partition, one matrix at a time.

    ``side`` is 0 for the members of block x and 1 for those of y (a diagonal tile has side 0 only). ``absent`` is the
    share of a term that the group lacks, ``width`` the number of terms of the chunk, ``at`` and ``p`` its other shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk = None, None
        sums = np.zeros((block, block), np.int64)
        sides: tuple[dict[int, np.ndarray], dict[int, np.ndarray]] = ({}, {})

        def fold() -> None:
            """Add the chunk that has just ended."""
            if not sides[0]:
                return
            other = sides[1] if tile[1] != tile[2] else sides[0]
            if other:
                columns = np.array(list(other))
                q = np.stack(list(other.values()))
                for i, p in sides[0].items():
                    gap = q - p
                    sums[i, columns] += (gap * gap // (q + p)).sum(axis=1)
            sides[0].clear()
            sides[1].clear()

        seen: tuple[set[int], set[int]] = (set(), set())

        def ended() -> Iterator[pa.RecordBatch]:
            fold()
            if tile is not None:
                same = tile[1] == tile[2]
                i, j = (np.array([(i, j) for i in sorted(seen[0]) for j in sorted(seen[0] if same else seen[1]) if not same or i < j], np.int64).reshape(-1, 2)).T
                n = len(i)
                columns = [pa.array([tile[0]] * n, pa.string()), pa.array([tile[1]] * n, pa.int32()), pa.array([tile[2]] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], ["lang", "x", "y", "i", "j", "value"])
            sums[:] = 0
            seen[0].clear()
            seen[1].clear()

        for batch in batches:
            lang, x, y, chunks, side, member, width, absent, at, p = batch.columns
            for k in range(len(batch)):
                here = (lang[k].as_py(), x[k].as_py(), y[k].as_py())
                if here != tile:
                    yield from ended()
                    tile, chunk = here, None
                if chunks[k].as_py() != chunk:
                    fold()
                    chunk = chunks[k].as_py()
                vector = np.full(width[k].as_py(), absent[k].as_py(), np.int64)
                vector[at[k].values.to_numpy()] = p[k].values.to_numpy()
                s, m = side[k].as_py(), member[k].as_py()
                sides[s][m] = vector
                seen[s].add(m)
        yield from ended()

    return run


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank) for documents with ``lang``, ``source`` and ``text``.

    Part ``pair``: the distance of a group to each other source of its language. Part ``term``: the ``top`` terms that the
    group has more often than its language. A language keeps the terms that at least ``least_docs`` of its documents have;
    without any, its pairs have the value 0 and it has no terms. Nulls count as empty strings, groups without text are
    listed too; repeated rows count each; an empty table gives an empty result; other columns are left out.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = staged(docs.select("lang", "source").distinct(), "div-groups")
    counts = staged(term_counts(docs), "div-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = staged(by_lang.select("lang", "term", "lang_n"), "div-kept")
    size = staged(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "div-size")
    # Chunks of the vocabulary by hash, places within a chunk by term.
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)).cast("int")
    cut = kept.join(size, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    vocabulary = staged(cut.withColumn("at", place.cast("int")), "div-vocabulary")
    found = staged(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "lang_total", "v", "chunk", "at"), "div-found")
    discard(counts, kept)
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # Every group: its total, the size of its language's vocabulary, its block and its place in the block.
    order = _numbered(groups)
    known = order.join(totals, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", "no", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    known = staged(known.withColumn("block", F.floor(F.col("no") / block).cast("int")).withColumn("member", F.pmod("no", F.lit(block)).cast("int")), "div-known")

    widths = vocabulary.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("width"))
    shares = found.select("lang", "source", "chunk", "at", "n").join(known.select("lang", "source", "total", "v"), ["lang", "source"])
    packed = shares.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", share(F.col("n"), F.col("total"), F.col("v")).alias("p")))).alias("held"))
    # Each group has a vector of every chunk, also where it has none of its terms.
    grid = known.where("v > 0").join(widths, "lang")
    vectors = grid.join(packed, ["lang", "source", "chunk"], "left")
    empty = F.expr("cast(array() as array<struct<at:int,p:bigint>>)")
    vectors = vectors.select("lang", "block", "member", "chunk", "width", share(F.lit(0), F.col("total"), F.col("v")).alias("absent"), F.coalesce("held", empty).alias("held"))
    blocks = known.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiled = vectors.join(blocks, "lang").withColumn("other", other)
    tiled = tiled.select("lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"), "member", "width", "absent", F.col("held.at").alias("at"), F.col("held.p").alias("p"))
    placed = tiled.repartition(parallelism(docs.sparkSession), "lang", "x", "y").sortWithinPartitions("lang", "x", "y", "chunk")
    matrix = staged(placed.mapInArrow(_tiles(block), "lang string, x int, y int, i int, j int, value bigint"), "div-matrix")

    names = known.select("lang", F.col("source"), "block", "member")
    # Languages without kept terms have no tiles: their pairs are 0.
    values = matrix.select("lang", (F.col("x") * block + F.col("i")).alias("a"), (F.col("y") * block + F.col("j")).alias("b"), "value")
    values = values.union(values.select("lang", "b", "a", "value"))
    number = F.col("block") * block + F.col("member")
    first = names.select("lang", number.alias("a"), "source")
    second = names.select("lang", number.alias("b"), F.col("source").alias("item"))
    pairs = values.join(first, ["lang", "a"]).join(second, ["lang", "b"]).select("lang", "source", "item", "value")
    bare = known.where("v = 0").select("lang", "source")
    nothing = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = pairs.union(nothing).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    p = share(F.col("n"), F.col("total"), F.col("v"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    over = found.join(known.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    terms = over.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pair_part.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _numbered(groups: DataFrame) -> DataFrame:
    """(lang, source, no): groups numbered from 0 within their language."""
    return groups.withColumn("no", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))


def query_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: every pair of sources of a language, and the ten terms that stand out in each source."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT k) AS df FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (kept.term IS NOT NULL), 0)::HUGEINT AS total
       FROM g LEFT JOIN c USING (lang, source) LEFT JOIN kept ON kept.lang = c.lang AND kept.term = c.term GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n,
             1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * v.v) AS p,
             1 + ({SCALE}::HUGEINT * (kept.n::HUGEINT + 2)) // (v.total + 2 * v.v) AS q
      FROM gt JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL
      SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
