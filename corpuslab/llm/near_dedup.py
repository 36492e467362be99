"""Near-duplicate documents by HyperMinHash.

Sketch: each shingle hash falls into one of 256 buckets by its leading bits; a bucket keeps the smallest rest, compressed
to its count of leading zeros (6 bits) and the ten mantissa bits after the first one. Empty buckets borrow from a bucket
chosen by a fixed random priority, so that short sets collide at their similarity too. Bands of six registers propose
candidates: a pair with similarity 0.8 is missed by all 42 bands with a chance of about 3 in a million.

Candidates are never expanded into all pairs of a bucket. Equal sets are one node from the start. Each node is compared
with one centre (the smallest node of most of its buckets); nodes that link are members of that centre's hub. A few turns
of star comparisons follow, each hub against some nodes of the largest component it meets in its buckets, which connect
what belongs together. What is left are hubs that meet in a bucket and are not connected. Since the Jaccard distance is a
metric, their members can link only if the hubs are nearer than the link distance plus the members' own distances; hubs
that may be so near form a field, and in a field every node outside the largest component is compared with the nodes of
all other components, as queries that are held while the members stream past. Comparison first estimates from the
registers, corrected for chance collisions, with a margin of five standard errors; what passes is confirmed on the full
shingle sets.

Documents are compared by streaming a centre's members past the centre; a large hub is cut into salted parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.components import connected_components
from corpuslab.llm.staging import discard, staged

BUCKETS, ROWS, MANTISSA = 256, 6, 10
BANDS = BUCKETS // ROWS
#: Five standard errors of the estimate from 256 registers, at its widest.
MARGIN = 5 * 0.5 / BUCKETS**0.5
#: Turns of star comparisons, and centres that a hub is compared with in each, before the exact last one.
STAR_TURNS, STAR_CENTRES = 1, 4
#: Members of a hub that one part of it holds.
PART = 2000
#: Hubs of a bucket that a task compares with one another at a time.
BLOCK = 512
#: Queries that are held in memory at a time.
QUERIES = 1024
_priority = np.argsort(np.random.Generator(np.random.PCG64(7)).random((BUCKETS, BUCKETS)), axis=1).astype(np.uint8)


def shingle_sets(words: K.Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words has its whole sequence as the only one."""
    hashes = K.sequence_hash(words.hash, width)
    for i in range(words.rows):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= width:
            yield np.unique(hashes[a : b - width + 1])
        elif b > a:
            yield np.array([K.whole_hash(words.hash[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def registers(values: np.ndarray) -> np.ndarray:
    """The 256 registers (uint16: leading zeros, then mantissa) of a sorted, non-empty set of hashes."""
    bucket = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = values[first] << np.uint64(8)
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    zeros[rest >> np.uint64(11) == 0] = 53
    fraction = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(BUCKETS, np.uint16)
    full = bucket[first]
    out[full] = (zeros.astype(np.uint16) << MANTISSA) | fraction.astype(np.uint16)
    if len(full) < BUCKETS:
        empty = np.ones(BUCKETS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[full[_priority[np.ix_(empty, full)].argmin(1)]]
    return out


def chance_collision(load: float) -> float:
    """Chance that two unrelated registers are equal, each the minimum of ``load`` values on average."""
    z = np.arange(54)
    width = 2.0 ** -(z + 1)
    return float(np.sum(width * 2.0**-MANTISSA * load / 2 * (np.exp(-2 * load * width) - np.exp(-4 * load * width))))


def estimate(a: np.ndarray, b: np.ndarray, size: float) -> float:
    """Jaccard similarity from two sketches, corrected for chance collisions."""
    c = chance_collision(max(1.0, size / BUCKETS))
    return (float((a == b).mean()) - c) / (1 - c)


def _sketch(width: int, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            sizes, keys, regs = [], [], []
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                for values in shingle_sets(K.Words(data[own[0] : own[-1]], own - own[0], table), width):
                    sizes.append(len(values))
                    if len(values):
                        keys.append(int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True))
                        regs.append(registers(values).tobytes())
                    else:
                        keys.append(None)
                        regs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(regs, pa.binary())], ["id", "n", "node", "regs"])

    return run


def _compare(width: int, table: np.ndarray, least: float):
    """Rows come by hub part, the centre first: (centre, part, role, node, regs, text) -> (a, b, jaccard) of pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_set, centre_regs = None, None, None
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            data, offsets = K.column_bytes(col["text"])
            number = {name: col[name].to_pylist() for name in ("centre", "role", "node")}
            regs = col["regs"].to_pylist()
            out: list[tuple[int, int, float]] = []
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                for i, values in enumerate(shingle_sets(K.Words(data[own[0] : own[-1]], own - own[0], table), width), first):
                    if not len(values) or int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True) != number["node"][i]:
                        continue  # another text under the same id
                    mine = np.frombuffer(regs[i], np.uint16)
                    if number["role"][i] == 0:
                        centre, centre_set, centre_regs = number["centre"][i], values, mine
                        continue
                    if centre != number["centre"][i]:
                        continue
                    if estimate(mine, centre_regs, (len(values) + len(centre_set)) / 2) < least - MARGIN:
                        continue
                    small, large = sorted((values, centre_set), key=len)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    shared = int((large[at] == small).sum())
                    union = len(values) + len(centre_set) - shared
                    if shared >= least * union - 1e-9:
                        out.append((number["node"][i], centre, shared / union))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "jaccard"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, table: np.ndarray, least: float, name: str) -> DataFrame:
    """``pairs`` (node, centre) that link, as (a, b, jaccard); texts: (node, regs, text)."""
    parts = staged(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "near-parts")  # so that joins with it can be split
    members = pairs.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    members = members.join(texts, "node").select("centre", "part", F.lit(1).alias("role"), "node", "regs", "text")
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    centres = centres.join(texts, centres["centre"] == texts["node"]).select("centre", "part", F.lit(0).alias("role"), "node", "regs", "text")
    rows = members.union(centres).repartition("centre", "part").sortWithinPartitions("centre", "part", "role")
    return staged(rows.mapInArrow(_compare(width, table, least), "a bigint, b bigint, jaccard double"), name)


def _tie(least: float):
    """Rows (key, a, b, side, hub, component, d, regs), sorted by block: star edges (a, b) of hubs of a block that hang together by pairs that may be near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(block) < 2:
                return
            side = np.array([r[0] for r in block])
            hub, component = (np.array([r[k] for r in block], np.int64) for k in (1, 2))
            d = np.array([r[3] for r in block])
            regs = np.stack([np.frombuffer(r[4], np.uint16) for r in block])
            rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            low = np.arange(len(block))
            near = np.zeros((len(rows), len(columns)), bool)
            for at in range(0, len(rows), 64):
                own = rows[at : at + 64]
                equal = (regs[own][:, None, :] == regs[columns][None, :, :]).mean(2)
                near[at : at + 64] = (equal >= least - d[own][:, None] - d[columns][None, :] - MARGIN) & (component[own][:, None] != component[columns][None, :])
            while near.any():  # the lowest row that hangs together with each
                before = low.copy()
                np.minimum.at(low, rows, np.where(near, low[columns], len(low)).min(1))
                np.minimum.at(low, columns, np.where(near, low[rows][:, None], len(low)).min(0))
                if (low == before).all():
                    break
            tied = np.flatnonzero(low != np.arange(len(low)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(hub[tied]), pa.array(hub[low[tied]])], ["a", "b"])

        for batch in batches:
            col = [batch.column(i).to_pylist() for i in range(8)]
            for k, a, b, *rest in zip(*col, strict=True):
                if (k, a, b) != key:
                    yield from done()
                    key, block = (k, a, b), []
                block.append(rest)
        yield from done()

    return run


def _fields(one: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between hubs of different components that meet in a bucket and may have near members, by the estimate
    and the metric. A bucket is compared block against block inside a task and gives an edge a hub at most."""
    blocks = one.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = one.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("hub"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("side", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1))
    rows = rows.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "side", "hub", "component", "d")
    rows = rows.join(nodes.select(F.col("node").alias("hub"), "regs"), "hub").select("key", "a", "b", "side", "hub", "component", "d", "regs")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return rows.mapInArrow(_tie(least), "a bigint, b bigint")


def _search(width: int, table: np.ndarray, least: float):
    """Rows (field, part, chunk, role, node, component, regs, text), queries (role 0) first: links (a, b) of queries and members.

    What a link has connected in this task is not compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, regs = None, [], [], []
        sizes = roots = sketches = None
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for batch in batches:
            data, offsets = K.column_bytes(batch.column(7))
            field, part, chunk, role, node, component, sketch = (batch.column(i).to_pylist() for i in range(7))
            out: list[tuple[int, int]] = []
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                for i, values in enumerate(shingle_sets(K.Words(data[own[0] : own[-1]], own - own[0], table), width), first):
                    if (field[i], part[i], chunk[i]) != key:
                        key, ids, sets, regs, sizes, parent = (field[i], part[i], chunk[i]), [], [], [], None, {}
                        members = []
                    mine = np.frombuffer(sketch[i], np.uint16)
                    if role[i] == 0:
                        ids.append(node[i])
                        sets.append(values)
                        regs.append(mine)
                        members.append(component[i])
                        continue
                    if not ids or not len(values):
                        continue
                    if sizes is None:
                        sizes, sketches, roots = np.array([len(x) for x in sets]), np.stack(regs), np.array(members)
                    here = root(component[i])
                    fits = np.flatnonzero((roots != here) & (np.minimum(sizes, len(values)) >= least * np.maximum(sizes, len(values)) - 1e-9))
                    if len(fits):
                        fits = fits[(sketches[fits] == mine).mean(1) >= least - MARGIN]
                    for q in fits:
                        if roots[q] == here:
                            continue
                        small, big = sorted((values, sets[q]), key=len)
                        at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                        shared = int((big[at] == small).sum())
                        if shared >= least * (len(small) + len(big) - shared) - 1e-9:
                            out.append((ids[q], node[i]))
                            old = roots[q]
                            parent[int(old)] = here
                            roots[roots == old] = here
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _searched(queries: DataFrame, members: DataFrame, texts: DataFrame, width: int, table: np.ndarray, least: float, name: str) -> DataFrame:
    """Each query (field, node, component) against the members of its field in other components, in chunks of queries and parts of members."""
    counted = queries.groupBy("field").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    counted = counted.join(members.groupBy("field").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "field")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asked = queries.join(counted, "field").withColumn("chunk", one("chunks")).select("field", F.explode(every("parts")).alias("part"), "chunk", F.lit(0).alias("role"), "node", "component")
    rest = members.join(counted, "field").withColumn("part", one("parts")).select("field", "part", F.explode(every("chunks")).alias("chunk"), F.lit(1).alias("role"), "node", "component")
    rows = asked.union(rest).join(texts, "node").select("field", "part", "chunk", "role", "node", "component", "regs", "text")
    rows = rows.repartition("field", "part", "chunk").sortWithinPartitions("field", "part", "chunk", "role")
    return staged(rows.mapInArrow(_search(width, table, least), "a bigint, b bigint"), name)


def _mixed(home: DataFrame, grouped: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of the buckets that hold several components, with the component; and whether there are any."""
    named = home.join(grouped.select(F.col("node").alias("hub"), "component"), "hub", "left").withColumn("component", F.coalesce("component", "hub"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    out = staged(named.join(mixed, "key"), "near-hubs")
    return out, not out.isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, table: np.ndarray = K.SPACE_WORDS) -> DataFrame:
    """One row a document: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id reachable over links.

    Two documents link if the Jaccard similarity of their shingle sets is ``least`` or more; words are lower-cased
    (A-Z). Documents without words have no shingles, link with nothing and are their own component. Rows with the same
    text are one node whatever their number; rows with a null id follow their text's component, but a text that occurs
    under null ids alone links with nothing. Ids must be integers. Other columns are not carried, so none clashes; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    sketch = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(_sketch(width, table), "id bigint, n bigint, node bigint, regs binary")
    sketch = staged(sketch, "near-sketch")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("n", "regs")).alias("s"))
    nodes = staged(nodes.select("node", "id", "s.n", "s.regs"), "near-nodes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("regs"), b * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keyed = nodes.where("id is not null").select("node", F.explode(bands).alias("key"))
    shared = staged(keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre < other").select("key", "centre"), "near-shared")
    met = staged(keyed.join(shared, "key"), "near-met")  # (key, node, centre) of buckets with two nodes or more

    votes = met.where("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("n"))
    first = staged(votes.groupBy("node").agg(F.max_by("centre", F.struct("n", -F.col("centre").cast("decimal(20,0)"))).alias("centre")), "near-first")
    wanted = met.select("node").distinct()
    texts = nodes.join(wanted, "node").join(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")), "id").select("node", "regs", "text")
    texts = staged(texts, "near-texts")

    compared = first
    links = _verified(first, texts, width, table, least, "near-links")
    member_of = links.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("jaccard")).alias("d"))
    home = met.select("key", "node").join(member_of, "node", "left")
    home = staged(home.select("key", "node", F.coalesce("hub", "node").alias("hub"), F.coalesce("d", F.lit(0.0)).alias("d")), "near-home")
    edges = links.select("a", "b")
    grouped = connected_components(edges, "near-groups")
    for turn in range(STAR_TURNS):
        hubs, open_keys = _mixed(home, grouped)
        if not open_keys:
            break
        # Per bucket one centre out of its largest component; each hub of another one is compared with the centres it meets most.
        sizes = staged(hubs.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
        ranked = F.struct("size", F.xxhash64(F.lit(turn), "node", "key"), F.col("node").alias("centre"), F.col("component").alias("own"))
        heads = hubs.join(sizes, "component").groupBy("key").agg(F.max(ranked).alias("h")).select("key", "h.centre", "h.own")
        votes = hubs.select("key", "hub", "component").distinct().join(heads, "key").where("component <> own").groupBy("hub", "centre").agg(F.count(F.lit(1)).alias("n"))
        best = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("n"), "centre"))
        pairs = votes.withColumn("rank", best).where(F.col("rank") <= STAR_CENTRES).select(F.col("hub").alias("node"), "centre")
        pairs = staged(pairs.join(compared, ["node", "centre"], "left_anti"), "near-star")
        found = _verified(pairs, texts, width, table, least, "near-star-links")
        compared = compared.union(pairs)
        edges = edges.union(found.select("a", "b"))
        grouped = connected_components(edges, "near-groups")

    # Exactly what is left: hubs of different components that may be near enough form fields; within a field, all nodes
    # outside its largest component are compared with all nodes of other components.
    hubs, open_keys = _mixed(home, grouped)
    if open_keys:
        ties = _fields(hubs.groupBy("key", "hub", "component").agg(F.max("d").alias("d")), nodes, least)
        field = connected_components(ties, "near-fields").withColumnRenamed("component", "field")
        belongs = home.select("hub", "node").distinct().union(home.select("hub", F.col("hub"))).distinct()
        belongs = belongs.join(grouped.select(F.col("node").alias("hub"), "component"), "hub", "left").select(F.col("hub"), F.col("node"), F.coalesce("component", "hub").alias("component"))
        members = staged(belongs.join(field.select(F.col("node").alias("hub"), "field"), "hub").select("field", "node", "component").distinct(), "near-members")
        sizes = members.groupBy("field", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("field").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        queries = members.join(largest, "field").where("component <> largest").select("field", "node", "component")
        found = _searched(queries, members, texts, width, table, least, "near-found")
        edges = edges.union(found.select("a", "b"))
        grouped = connected_components(edges, "near-final")
    final = grouped
    discard(shared, met, first, texts, links, home)

    least_id = nodes.select("node", "id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = staged(least_id.groupBy("component").agg(F.min("id").alias("component_id")).where("component_id is not null"), "near-smallest")
    by_node = least_id.join(smallest, "component").select("node", "component_id")
    out = sketch.select("id", "n", "node").join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def query_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the contract of this query: two-word shingles, similarity 0.8."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=2)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
