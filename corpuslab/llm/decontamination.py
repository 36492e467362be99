"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window). The set of a window
is its shingles, and a document contains the window only if it contains every shingle, so one token of the window is a
necessary prefix: the rarest one. Rarity is counted over all documents in a first pass, which adds up hashed shingles in
a table of fixed size, whatever the benchmark holds; shingles that share a counter only make the choice a little worse.
The second pass joins the shingles of each document with the prefix tokens only; the place of the token within its window and the bounds of the
document say where the window would have to lie (positional and length bounds), and there the words are compared one by
one.

The benchmark is read in blocks of bounded size; each block is sent to the executors and compared with all documents.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.staging import free_names, with_body

SHINGLE = 3
#: UTF-8 bytes of benchmark text in one block (what is sent to an executor at a time is some ten times that), counters of
#: rarity, and slices of text that are compared with a block while it is open.
BLOCK_BYTES, COUNTERS, SLICES = 8 << 20, 1 << 17, 8


class Block:
    """Windows of some benchmark items: word hashes (padded), lengths, items; and their shingles."""

    def __init__(self, items: list[tuple[object, str]], window: int) -> None:
        text = pa.array([t for _, t in items], pa.large_string())
        data, offsets = K.column_bytes(text)
        words = K.Words(data, offsets, K.ALNUM_WORDS)
        self.item_ids = [i for i, _ in items]
        rows, lengths, owners = [], [], []
        for i in range(len(items)):
            own = words.hash[words.bounds[i] : words.bounds[i + 1]]
            if len(own) == 0:
                continue
            n = min(window, len(own))
            for k in range(len(own) - n + 1):
                rows.append(np.pad(own[k : k + n], (0, window - n)))
                lengths.append(n)
                owners.append(i)
        self.words = np.array(rows, np.uint64).reshape(len(rows), window)
        self.length = np.array(lengths, np.int64)
        self.owner = np.array(owners, np.int64)
        # Shingles: three words, or all of a window that is shorter.
        shingles, of, at = [], [], []
        for width in range(1, SHINGLE + 1):
            pick = np.flatnonzero(self.length == width) if width < SHINGLE else np.flatnonzero(self.length >= SHINGLE)
            for k in range(1 if width < SHINGLE else window - width + 1):
                own = pick[self.length[pick] >= k + width]
                if len(own):
                    h = np.full(len(own), np.uint64(width), np.uint64)
                    for j in range(width):
                        h = K.mix(h * K._BASE + self.words[own, k + j])
                    shingles.append(h)
                    of.append(own)
                    at.append(np.full(len(own), k, np.int64))
        empty = np.zeros(0, np.int64)
        self.shingle = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
        self.of, self.at = (np.concatenate(x) if x else empty for x in (of, at))
        self.widths = sorted({int(min(SHINGLE, n)) for n in set(lengths)})

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """Keep the rarest shingle of each window (ties: the smaller hash, then the earlier place)."""
        order = np.lexsort((self.at, self.shingle, counts[(self.shingle % np.uint64(COUNTERS)).astype(np.int64)], self.of))
        first = order[np.unique(self.of[order], return_index=True)[1]]
        by_hash = first[np.argsort(self.shingle[first], kind="stable")]
        self.prefix = self.shingle[by_hash]
        self.prefix_window, self.prefix_at = self.of[by_hash], self.at[by_hash]
        self.known, self.known_begin = np.unique(self.prefix, return_index=True)
        self.known_end = np.append(self.known_begin[1:], len(self.prefix))
        self.shingle = self.of = self.at = None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` whose value is known, and its number."""
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << 20, bool)
            self._sieve[(self.known >> np.uint64(44)).astype(np.int64)] = True
        maybe = np.flatnonzero(self._sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        number = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        hit = self.known[number] == hashes[maybe]
        return maybe[hit], number[hit]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_sieve"}


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[Block]:
    items, size = [], 0
    for row in benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).toLocalIterator():
        items.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= block_bytes:
            yield Block(items, window)
            items, size = [], 0
    if items:
        yield Block(items, window)


def _open(shared: Broadcast, keep: bool) -> Block:
    value = shared.value
    if not keep:  # one block in memory at a time
        shared.__dict__.pop("_value", None)
    return value


def _count(widths: list[int]):
    """Hashed shingles of all documents, as (number of a counter, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(0))
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                words = K.Words(data[own[0] : own[-1]], own - own[0], K.ALNUM_WORDS)
                for width in widths:
                    hashes = K.sequence_hash(words.hash, width)
                    counts += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["number", "n"])

    return run


def rarity(docs: DataFrame, text: str, widths: list[int]) -> np.ndarray:
    """How often the shingles of each counter occur in the documents."""
    counts = np.zeros(COUNTERS, np.int64)
    counted = docs.select(text).mapInArrow(_count(widths), "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # COUNTERS rows at most
        counts[row["number"]] = row["n"]
    return counts


def _match(block: Block, words: K.Words, row_of: np.ndarray, found: list[set], cover: np.ndarray, window: int) -> None:
    """Add the items of a block that occur in each row to ``found``, and their words to ``cover`` (as differences)."""
    for width in block.widths:
        places, numbers = block.find(K.sequence_hash(words.hash, width))
        if not len(places):
            continue
        many = block.known_end[numbers] - block.known_begin[numbers]
        places = np.repeat(places, many)
        which = np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(block.known_begin[numbers], many)
        at, wins = block.prefix_at[which], block.prefix_window[which]
        size, row, start = block.length[wins], row_of[places], places - at
        fits = (start >= words.bounds[row]) & (start + size <= words.bounds[row + 1]) & (np.minimum(size, SHINGLE) == width)
        start, wins, size, row = start[fits], wins[fits], size[fits], row[fits]
        for k in range(window):
            there = np.minimum(start + k, len(words.hash) - 1)
            same = (k >= size) | (words.hash[there] == block.words[wins, k])
            if not same.all():
                start, wins, size, row = start[same], wins[same], size[same], row[same]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
        for r, o in set(zip(row.tolist(), block.owner[wins].tolist(), strict=True)):
            found[r].add(block.item_ids[o])


def _hits(shared: list[Broadcast], n_carry: int, window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(n_carry))
            n_words, n_hit, spans, items = [], [], [], []
            parts = list(K.slices(offsets))
            for at in range(0, len(parts), SLICES):
                group = []
                for first, last in parts[at : at + SLICES]:
                    own = offsets[first : last + 1]
                    words = K.Words(data[own[0] : own[-1]], own - own[0], K.ALNUM_WORDS)
                    group.append((words, np.repeat(np.arange(words.rows), words.count), [set() for _ in range(words.rows)], np.zeros(len(words.hash) + 1, np.int64)))
                for block in (_open(b, len(shared) == 1) for b in shared):
                    for words, row_of, found, cover in group:
                        _match(block, words, row_of, found, cover, window)
                for words, _, found, cover in group:
                    hit = np.cumsum(cover[:-1]) > 0
                    for i in range(words.rows):
                        a, b = words.bounds[i], words.bounds[i + 1]
                        n_words.append(int(b - a))
                        items.append(sorted(found[i]))
                        if not found[i]:
                            n_hit.append(0)
                            spans.append([])
                            continue
                        inside = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                        n_hit.append(int(hit[a:b].sum()))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1), strict=True)])
            extra = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_carry)] + extra, names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: the ``carry`` columns, then ``n_words``, ``n_hit``, ``items`` and ``hit_spans`` (word ranges).

    Words are compared after lower-casing A-Z. A null text has no words. Items with a null id or without words match
    nothing; repeated items and repeated documents are each compared. An empty benchmark leaves every document clean.
    ``item_id`` must be an integer. The four result columns get other names if ``carry`` holds them already.
    """
    spark = docs.sparkSession
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    lowered = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    size = F.least(F.regexp_count(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(SHINGLE))
    widths = sorted(r[0] for r in benchmark.select(size.alias("width")).where("width > 0").distinct().collect())
    counts, shared = rarity(docs, text, widths), []
    for block in _blocks(benchmark, item_id, item_text, window, block_bytes):
        if len(block.length):
            block.order_by_rarity(counts)
            shared.append(spark.sparkContext.broadcast(block))
    names = free_names(docs.select(*carry), "n_words", "n_hit", "items", "hit_spans")
    kinds = ("bigint", "bigint", "array<bigint>", "array<struct<start:bigint,end:bigint>>")
    schema = docs.select(*carry, *[F.lit(None).cast(kind).alias(name) for name, kind in zip(names, kinds, strict=True)]).schema
    return with_body(docs, carry, text).mapInArrow(_hits(shared, len(carry), window, schema.names), schema)


def query_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, ten-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
iw AS (SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM iw WHERE len(w) > 0)),
grams AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
                FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
found AS (SELECT doc_id, k, grams.n, item_id FROM grams JOIN wins USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 sha256(array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',')) AS items_sha256
          FROM found GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
