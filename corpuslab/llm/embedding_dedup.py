"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. After a random rotation a vector is split into blocks of
sixteen dimensions; if two vectors are within the squared distance D, at least one of the m blocks is within D / m. So
the candidates of the m range joins, one a block, contain every link, and each candidate is verified exactly in double
precision.

Distribution: equal vectors of a label are one node. The nodes of a label are dealt by hash into as many cells as its
population asks for, and each two cells meet in one task, which joins all blocks; so a vector moves once for each cell
of its label, and a pair is decided in one place. The tasks are dealt into slices, one after another, each of which moves
about as much as the table holds; its shuffle files are deleted before the next. In a task one side is cut by medians
into orthants of each block, and an orthant is compared with those of the other side that are within range of it. A pair
met in several blocks counts in the first one. A task returns only the number of links of each vector and the merges of
its parts of the graph, never pairs, so a dense group costs no more output than its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.components import connected_components
from corpuslab.llm.staging import discard, staged
from corpuslab.session import shuffles_dropped

BLOCK = 16
#: Nodes of a cell, nodes that an orthant should hold, and rows and columns of a comparison.
CELL, CHUNK, TILE, WIDE = 1 << 17, 128, 2048, 128
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix, padded with zero columns to whole blocks."""
    if dim not in _rotations:
        q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, dim)))
        _rotations[dim] = np.pad(q, ((0, 0), (0, -dim % BLOCK)))
    return _rotations[dim]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def orthants(x: np.ndarray, y: np.ndarray, reach: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``x``, rows of ``y``): every two rows within the squared distance ``reach`` are together in one of them.

    ``y`` is cut at the medians of its widest dimensions into orthants of about ``size`` rows; a row of ``x`` comes to
    those whose squared distance from it is within reach."""
    splits = int(np.log2(len(y) / size)) if len(y) > size else 0
    dims = [d for d in np.argsort(-y.std(0), kind="stable")[:splits] if y[:, d].min() < y[:, d].max()]
    middle = np.median(y[:, dims], axis=0) if dims else np.zeros(0, y.dtype)
    code = ((y[:, dims] >= middle) @ (1 << np.arange(len(dims))[::-1])).astype(np.int64)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange((1 << len(dims)) + 1))
    off = np.ascontiguousarray((x[:, dims] - middle).T)

    def walk(depth: int, prefix: int, rows: np.ndarray, cost: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rest = len(dims) - depth
        low, high = starts[prefix << rest], starts[(prefix + 1) << rest]
        if low == high or not len(rows):
            return
        if not rest:
            yield rows, order[low:high]
            return
        at = off[depth][rows]
        for bit in (0, 1):
            total = cost + np.maximum(-at if bit else at, 0) ** 2
            near = total <= reach
            yield from walk(depth + 1, 2 * prefix + bit, rows[near], total[near])

    yield from walk(0, 0, np.arange(len(x)), np.zeros(len(x), x.dtype))


class _Side:
    """Nodes of one cell; ``turned`` holds the rotated unit vectors, ``part`` the lowest node of its part of the graph so far."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, vec: np.ndarray) -> None:
        self.node, self.weight, self.vec = node, weight, vec
        self.links, self.part = np.zeros(len(node), np.int64), node.copy()
        turn = rotation(vec.shape[1])
        self.turned = np.empty((len(node), turn.shape[1]), np.float32)
        for a in range(0, len(node), TILE):
            self.turned[a : a + TILE] = units(vec[a : a + TILE].astype(np.float64)) @ turn


def _joined(left: _Side, right: _Side, least: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, low): links of every node that has some (low is the node), and merges of parts of the graph (no links)."""
    blocks = left.turned.shape[1] // BLOCK
    budget = max(0.0, 2 - 2 * least) / blocks + 1e-6
    merges = [np.zeros((0, 2), np.int64)]
    for block in range(blocks):
        x, y = (s.turned[:, block * BLOCK : (block + 1) * BLOCK] for s in (left, right))
        # One product gives squared distances: (-2x, |x|^2, 1) (y, 1, |y|^2)
        ones = [np.ones((len(s), 1), np.float32) for s in (x, y)]
        a = np.hstack([-2 * x, (x * x).sum(1, keepdims=True), ones[0]])
        b = np.hstack([y, ones[1], (y * y).sum(1, keepdims=True)])
        limit, here = np.float32(budget + 1e-5), np.zeros(max(len(x), len(y)), bool)
        for rows, columns in orthants(x, y, limit, size):
            for k in range(0, len(columns), WIDE):
                other = columns[k : k + WIDE]
                turned, here[other] = np.ascontiguousarray(b[other].T), left is right
                for i in range(0, len(rows), TILE):
                    some = rows[i : i + TILE]
                    near = a[some] @ turned <= limit
                    if np.count_nonzero(near) > np.count_nonzero(here[some]):  # more than the nodes themselves
                        _linked(left, right, block, budget, least, some, other, near, merges)
                here[other] = False
    sides = [left] if left is right else [left, right]
    node, links = (np.concatenate([getattr(s, name)[s.links > 0] for s in sides]) for name in ("node", "links"))
    old, new = np.unique(np.concatenate(merges), axis=0).T
    return np.concatenate([node, old]), np.concatenate([links, np.zeros(len(old), np.int64)]), np.concatenate([node, new])


def _linked(left: _Side, right: _Side, block: int, budget: float, least: float, rows: np.ndarray, columns: np.ndarray, near: np.ndarray, merges: list[np.ndarray]) -> None:
    """Count the links among the ``near`` pairs that no earlier block has met, and merge the parts that they join."""
    if left is right:
        near &= left.node[rows][:, None] < left.node[columns]
    i, k = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(i):
        return
    near, rows, columns = near[np.ix_(i, k)], rows[i], columns[k]
    near &= units(left.vec[rows].astype(np.float64)) @ units(right.vec[columns].astype(np.float64)).T >= least
    i, k = np.nonzero(near)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], k[at : at + (1 << 16)]
        for j in range(block + 1):
            part = slice(j * BLOCK, (j + 1) * BLOCK)
            apart = ((left.turned[rows[p], part].astype(np.float64) - right.turned[columns[q], part]) ** 2).sum(1)
            met = apart > budget if j == block else apart <= budget
            near[p[met], q[met]] = False
            p, q = p[~met], q[~met]
    i, k = near.any(1), near.any(0)
    if not i.any():
        return
    near, rows, columns = near[np.ix_(i, k)], rows[i], columns[k]
    count = near.astype(np.float64)  # a product of floats is fast, and exact for whole numbers up to 2^53
    left.links[rows] += (count @ right.weight[columns]).astype(np.int64)
    right.links[columns] += (count.T @ left.weight[rows]).astype(np.int64)
    before = left.part[rows], right.part[columns]
    (low_left, low_right), top = before, np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(low_left, np.where(near, low_right, top).min(1))
        new_right = np.minimum(low_right, np.where(near, new_left[:, None], top).min(0))
        if (new_left == low_left).all() and (new_right == low_right).all():
            break
        low_left, low_right = new_left, new_right
    # A part is named by its lowest node: where a name falls, the old name and the new one are in one part.
    old, new = np.concatenate(before), np.concatenate([low_left, low_right])
    merges.append(np.unique(np.column_stack([old, new])[old != new], axis=0))
    left.part[rows] = np.minimum(left.part[rows], low_left)
    right.part[columns] = np.minimum(right.part[columns], low_right)


def _compare(least: float, size: int):
    """Rows (label, dim, home, probe, role, node, weight, vec), sorted by the first four; role 0 home, 1 probe, 2 both."""

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        role, node, weight = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in (4, 5, 6))
        vec = np.concatenate([b.column(7).flatten().to_numpy() for b in parts]).reshape(len(node), -1)
        parts.clear()
        if role[0] == 2:
            left = right = _Side(node, weight, vec)
        else:
            left, right = (_Side(node[role == k], weight[role == k], vec[role == k]) for k in (0, 1))
            del vec
        if len(left.node) and len(right.node):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _joined(left, right, least, size)], ["node", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(4)])
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                now = tuple(keys[a])
                if now != key and parts:
                    yield from done(parts)
                key = now
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from done(parts)

    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        return staged(df, name)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", least: float = 0.98, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """``id_col``, ``n_links`` (other vectors of the label linked directly) and ``component_id`` (smallest id reachable) of each row.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label, link with
    nothing. Vectors of different dimension do not link. Equal vectors link whatever their number. Labels and ids must
    be integers; rows with a null id follow their vector's component. ``cell`` and ``chunk`` are the nodes of a cell and
    of an orthant; they change no result.
    """
    x = F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vec] == "array<float>" else "array<double>"  # floats stay half as large; links are decided in doubles
    good = x.isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vec).cast(kind).alias("v"))
    rows = rows.withColumn("node", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", "v")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("id"), F.first("v").alias("vec"))
    nodes = _kept(nodes.withColumn("dim", F.size("vec").cast("bigint")), "vec-nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("cells", F.ceil(F.col("n") / cell))
    large = _kept(sizes.where("cells > 1"), "vec-sizes")  # at most one row for each cell of nodes, so it is broadcast
    slices = large.agg(F.sum(F.col("n") * (F.col("cells") - 1))).first()[0] or 0
    slices = 1 + -(-slices // nodes.count()) if slices else 1
    own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("bigint")
    dealt = nodes.join(F.broadcast(large.drop("n")), ["label", "dim"], "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("bigint")))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)))
    role = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    tasks = dealt.select("label", "dim", F.least("own", "other").alias("home"), F.greatest("own", "other").alias("probe"), role.alias("role"), "node", "weight", "vec")
    found = []
    for k in range(slices):
        part = tasks.where(F.pmod(F.xxhash64("label", "dim", "home", "probe"), F.lit(slices)) == k) if slices > 1 else tasks
        part = part.repartition("label", "dim", "home", "probe").sortWithinPartitions("label", "dim", "home", "probe")
        found.append(_kept(part.mapInArrow(_compare(least, chunk), "node bigint, links bigint, low bigint"), "vec-links"))
    discard(large)
    found = reduce(DataFrame.union, found)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), "vec-groups")
    by_node = nodes.select("node", "id", "weight").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = staged(by_node.groupBy("component").agg(F.min("id").alias("component_id")), "vec-lowest")
    by_node = by_node.join(lowest, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", "node").join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def query_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.98 or more within a label."""
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
