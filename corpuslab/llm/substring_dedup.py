"""Removal of long repeated substrings by sharded external suffix sorting.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. The work is cut so that equal
strings meet in one shard, whatever their documents:

1. Every document finds its anchors (see :mod:`corpuslab.llm.anchors`); equal windows share an anchor.
2. Anchors that occur once stand for windows that occur once, and are done. Equal contexts of an anchor are counted: all
   windows of a context that occurs twice are repeats, and one of its copies goes on.
3. Anchors with several different contexts send one copy of each to the shard of the anchor. A shard is suffix sorted by
   external induced sorting with common-prefix values (see :mod:`corpuslab.llm.suffix_sort`); windows whose common
   prefix with a neighbour reaches ``length`` are repeats. Pieces and all that sorts them go to disk when they are large,
   so the memory of a task does not grow with its shard.
   An anchor with more bytes than a shard holds is cut first: its windows are classed by how far the anchor lies in them
   (equal windows agree in that), and each class by the bytes that all its windows must contain. So the contexts of a hot
   anchor fall apart by their surroundings, equal parts are counted, and what is still too much for a shard is cut again,
   by narrower classes down to single windows, which counting alone decides.
4. The repeats return to their documents, where covered bytes are cut out.

The text of a document moves only if it holds a repeated anchor; the others are told apart by a Bloom filter of bounded
size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.anchors import find_anchors
from corpuslab.llm.external import Vector
from corpuslab.llm.staging import discard, free_names, parallelism, staged
from corpuslab.llm.suffix_sort import repeated_runs

#: Bytes of context that a shard should have on average, and scale of the memory that sorting one takes (some four times that at most).
SHARD_BYTES, SORT_BYTES = 3 << 19, 64 << 20
#: Distances of the anchor that a class of windows of a hot anchor spans, from cut to cut.
CLASSES = (32, 4, 1)
#: Words of 64 bits of the Bloom filter: 16 bits a document, within these bounds.
FILTER_WORDS = (1 << 12, 1 << 20)


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = K.column_bytes(batch.column(1))
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                found = find_anchors(data[own[0] : own[-1]], own - own[0], length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first + found.row]), pa.array(found.first), pa.array((found.last - found.first).astype(np.int16)), pa.array((found.place - found.first).astype(np.int16)), pa.array(found.anchor), pa.array(found.context)], ["key", "first", "reach", "ahead", "anchor", "context"])

    return run


def _cut(length: int):
    """(key, text, wanted: array of (anchor, context, first, reach)) -> (anchor, context, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(0))
            wanted = batch.column(1)
            starts = wanted.offsets.to_numpy()
            fields = [wanted.values.field(i).to_numpy() for i in range(4)]
            anchor, context, pieces = [], [], []
            for i in range(batch.num_rows):
                for k in range(starts[i], starts[i + 1]):
                    begin = offsets[i] + fields[2][k]
                    anchor.append(fields[0][k])
                    context.append(fields[1][k])
                    pieces.append(data[begin : begin + fields[3][k] + length].tobytes())
                    if len(pieces) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(context, pa.int64()), pa.array(pieces, pa.binary())], ["anchor", "context", "piece"])
                        anchor, context, pieces = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(context, pa.int64()), pa.array(pieces, pa.binary())], ["anchor", "context", "piece"])

    return run


def _refine(length: int, step: int):
    """(text, wanted: array of (anchor, context, key, first, reach, ahead)) -> parts of each context by class, with the anchor and
    context that they stand for in the next round, and where they begin in theirs (base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "context", "base", "sub_anchor", "sub_context", "key", "first", "reach", "ahead"]
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(0))
            wanted = batch.column(1)
            starts = wanted.offsets.to_numpy()
            fields = [wanted.values.field(i).to_numpy() for i in range(6)]
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i in range(batch.num_rows):
                for k in range(starts[i], starts[i + 1]):
                    anchor, context, key, first, reach, ahead = (int(f[k]) for f in fields)
                    own = data[offsets[i] + first : offsets[i] + first + reach + length]
                    up, down = K.powers(len(own) + 1)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K._BYTE_CODE[own] * up[: len(own)], dtype=np.uint64)])
                    part = np.arange((ahead - reach) // step, ahead // step + 1)
                    low, high = np.maximum(0, ahead - (part * step + step - 1)), np.minimum(reach, ahead - part * step)
                    hashed = lambda a, b, sums=sums, down=down: K.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
                    shared = hashed(ahead - part * step, ahead - (part * step + step - 1) + length)  # what all windows of the class contain
                    whole = hashed(low, high + length)
                    base = np.array([anchor], np.int64).view(np.uint64)
                    sub = K.mix(K.mix(base + part.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(step)) ^ shared)
                    inner = K.mix(whole + (ahead - low).astype(np.uint64) * np.uint64(1_000_003))
                    n = len(part)
                    columns = (np.full(n, anchor), np.full(n, context), low, sub.view(np.int64), inner.view(np.int64), np.full(n, key), first + low, high - low, ahead - low)
                    for column, values in zip(out, columns, strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names)

    return run


def _sort(length: int, memory: int):
    """One shard a partition, in the order of anchor and context: (anchor, context, piece) -> (anchor, context, runs of repeated window starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, begins, names = Vector(np.uint8, memory // 16), Vector(np.int64, memory // 32), [Vector(np.int64, memory // 32) for _ in range(2)]
        last = None
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in (0, 1)]
            # Rows equal in all columns cut the same piece twice, which would look like a repeat: one each.
            keep = np.ones(batch.num_rows, bool)
            keep[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])
            if batch.num_rows:
                keep[0] = last != (own[0][0], own[1][0])
                last = (own[0][-1], own[1][-1])
            for part in range(0, batch.num_rows, 1000):
                at = part + np.flatnonzero(keep[part : part + 1000])
                data, offsets = K.column_bytes(batch.column(2).take(pa.array(at)))
                ends = offsets[1:] + np.arange(len(at))
                closed = np.zeros(len(data) + len(at), np.uint8)  # every piece is closed by 0; bytes of UTF-8 stay below 255
                inside = np.ones(len(closed), bool)
                inside[ends] = False
                closed[inside] = data + 1
                begins.append(len(text) + np.concatenate([[0], ends + 1])[: len(at)])
                text.append(closed)
                for name, column in zip(names, own, strict=True):
                    name.append(column[at])
        if not len(text):
            return
        first, known = 0, begins.read(0, 1 << 16)
        for begin, end in repeated_runs(text, length, memory):  # a run never crosses a piece: its closing byte repeats nothing
            at = 0
            while at < len(begin):
                limit = begins.read(first + len(known), first + len(known) + 1)
                upto = int(np.searchsorted(begin, limit[0], "left")) if len(limit) else len(begin)
                if upto > at:
                    piece = np.searchsorted(known, begin[at:upto], "right") - 1
                    anchor, context = (name.read(first, first + len(known))[piece] for name in names)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(begin[at:upto] - known[piece]), pa.array(end[at:upto] - 1 - known[piece])], ["anchor", "context", "low", "high"])
                    at = upto
                else:
                    first += len(known)
                    known = begins.read(first, first + (1 << 16))

    return run


def _remove(length: int, n_carry: int, names: list[str], with_text: bool):
    """(carry, text, runs: array of (first, last) window starts) -> carry, n_bytes, n_removed, n_spans, kept_sha256 (and kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(n_carry))
            runs = batch.column(n_carry + 1)
            starts, fields = runs.offsets.to_numpy(), [runs.values.field(i).to_numpy() for i in (0, 1)]
            removed, spans, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                cover = np.zeros(len(own) + 1, np.int32)
                part = slice(starts[i], starts[i + 1])
                np.add.at(cover, fields[0][part], 1)
                np.add.at(cover, fields[1][part] + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum()))
                rest = own[~gone].tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode("utf-8", "ignore"))  # a cut within a character leaves no half of it
            extra = [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(kept, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n_carry)] + extra, names)

    return run


def _mixed(contexts: DataFrame, name: str) -> DataFrame:
    """(anchor, context, key, first, reach, ahead): one copy of each context of the anchors that have several."""
    mixed = contexts.groupBy("anchor").agg(F.min("context").alias("x"), F.max("context").alias("y")).where("x < y").select("anchor")
    mixed = staged(mixed, f"{name}-anchors")  # a written side lets AQE split the other
    return staged(contexts.join(mixed, "anchor").select("anchor", "context", "copy.*"), name)


def _copied(contexts: DataFrame) -> DataFrame:
    """(anchor, context, low, high): contexts that occur twice or more, all of whose windows are repeats."""
    return contexts.where("n > 1").select("anchor", "context", F.lit(0).cast("bigint").alias("low"), F.col("copy.reach").alias("high"))


def _with_text(wanted: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    by_key = wanted.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return texts.join(by_key, "key").select("text", "wanted")


def _repeats(wanted: DataFrame, texts: DataFrame, length: int, shard_bytes: int, memory: int, classes: tuple[int, ...]) -> DataFrame:
    """(anchor, context, low, high): runs of windows of the ``wanted`` contexts that occur in another context of their anchor too."""
    sizes = wanted.groupBy("anchor").agg(F.sum(F.col("reach") + length).alias("bytes"))
    hot = staged(sizes.where(F.col("bytes") > shard_bytes).select("anchor"), "sub-hot")
    split = bool(classes) and not hot.isEmpty()
    cold = wanted.join(hot, "anchor", "left_anti") if split else wanted
    pieces = _with_text(cold, texts, "anchor", "context", "first", "reach").mapInArrow(_cut(length), "anchor bigint, context bigint, piece binary")
    total = cold.agg(F.sum(F.col("reach") + length)).first()[0] or 0
    shards = max(parallelism(wanted.sparkSession), int(total // shard_bytes) + 1)
    runs = pieces.repartition(shards, "anchor").sortWithinPartitions("anchor", "context").mapInArrow(_sort(length, memory), "anchor bigint, context bigint, low bigint, high bigint")
    runs = staged(runs, "sub-sorted")
    if not split:
        return runs
    rows = _with_text(wanted.join(hot, "anchor"), texts, "anchor", "context", "key", "first", "reach", "ahead")
    names = ("anchor", "context", "base", "sub_anchor", "sub_context", "key", "first", "reach", "ahead")
    parts = staged(rows.mapInArrow(_refine(length, classes[0]), ", ".join(f"{n} bigint" for n in names)), "sub-parts")
    own = parts.select("anchor", "context", "base", "sub_anchor", "sub_context", "key", "first", "reach", "ahead").distinct()  # repeated rows give the same part twice
    inner = own.groupBy(F.col("sub_anchor").alias("anchor"), F.col("sub_context").alias("context")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "reach", "ahead")).alias("copy"))
    inner = staged(inner, "sub-inner")
    deeper = _copied(inner).union(_repeats(_mixed(inner, "sub-again"), texts, length, shard_bytes, memory, classes[1:]))
    deeper = deeper.select(F.col("anchor").alias("sub_anchor"), F.col("context").alias("sub_context"), "low", "high")
    back = parts.join(deeper, ["sub_anchor", "sub_context"]).select("anchor", "context", (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high"))
    return runs.union(back)


def remove_repeats(docs: DataFrame, text: str = "text", carry: list[str] | None = None, length: int = 400, gram: int | None = None, shard_bytes: int = SHARD_BYTES, memory: int = SORT_BYTES, with_text: bool = False) -> DataFrame:
    """The ``carry`` columns (default: all but the text), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept``.

    Texts are UTF-8 bytes, null is empty; texts under ``length`` bytes lose nothing; repeated rows repeat each other, so
    they lose all they can. The result columns get other names if ``carry`` holds them already. An empty table gives an
    empty result.
    """
    gram = gram or length * 2 // 5
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    key, runs, word, mask, whole = free_names(docs, "key", "runs", "word", "mask", "whole")
    # Equal rows share a key: what one of them loses, all lose.
    hashed = [c for c in carry if "map<" not in dict(docs.dtypes)[c]]
    keyed = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias(whole)).withColumn(key, F.xxhash64(*hashed, whole))
    text = whole
    spark = docs.sparkSession
    found = keyed.where(F.octet_length(text) >= length).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_anchors(length, gram), "key bigint, first bigint, reach smallint, ahead smallint, anchor bigint, context bigint")
    found = staged(found, "sub-anchors")
    twice = staged(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "sub-twice")  # a written side lets AQE split the other
    every, found = found, staged(found.join(twice, "anchor"), "sub-repeated")
    discard(every, twice)
    contexts = found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", F.col("reach").cast("bigint").alias("reach"), F.col("ahead").cast("bigint").alias("ahead"))).alias("copy"))
    contexts = staged(contexts, "sub-contexts")
    wanted = _mixed(contexts, "sub-wanted")

    # A Bloom filter of the documents with a repeated anchor, of bounded size: one word a key, two bits in it.
    n_keys = found.select(F.approx_count_distinct("key")).first()[0]
    words = min(FILTER_WORDS[1], max(FILTER_WORDS[0], 1 << (n_keys // 4).bit_length()))
    bits = lambda k: F.expr(f"shiftleft(1L, cast(({k} >> 20) & 63 as int)) | shiftleft(1L, cast(({k} >> 26) & 63 as int))")
    sieve = found.select(F.pmod("key", F.lit(words)).alias("word"), bits("key").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("mask"))
    sieve = F.broadcast(staged(sieve, "sub-sieve").select(F.col("word").alias(word), F.col("mask").alias(mask)))
    sifted = keyed.withColumn(word, F.pmod(F.col(key), F.lit(words)))
    inside = F.col(mask).bitwiseAND(bits(key)) == bits(key)
    maybe = sifted.join(sieve, word).where(inside).drop(word, mask)

    texts = maybe.select(F.col(key).alias("key"), F.col(text).alias("text"))
    repeats = _copied(contexts).union(_repeats(wanted, texts, length, shard_bytes, memory, tuple(c for c in CLASSES if c <= length // 2) or (1,)))
    spans = found.join(repeats, ["anchor", "context"]).select("key", (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high")).alias("last"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias(runs))
    spans = staged(spans, "sub-spans")
    discard(found, contexts, wanted)

    names = free_names(docs.select(*carry), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
    kinds = ["bigint", "bigint", "bigint", "string", "string"]
    schema = docs.select(*carry, *[F.lit(None).cast(kind).alias(name) for name, kind in zip(names, kinds, strict=False)]).schema
    touched = maybe.join(spans.withColumnRenamed("key", key), key, "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    touched = touched.select(*carry, text, F.coalesce(runs, none).alias(runs)).mapInArrow(_remove(length, len(carry), schema.names, with_text), schema)
    clean = sifted.join(sieve, word, "left").where(~F.coalesce(inside, F.lit(False)))
    uncut = [F.octet_length(text).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.sha2(F.col(text).cast("binary"), 256), F.col(text)]
    return touched.union(clean.select(*carry, *[c.alias(name) for name, c in zip(names, uncut, strict=False)]))


def query_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 400 bytes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
