"""All occurrences of many fragments in texts: an automaton over tokens, one pass a document for each block of fragments.

Fragments and documents are arrays of tokens. Fragments are cut into blocks of bounded size; a block becomes one
Aho-Corasick automaton in each Python worker, and every document runs through it once, whatever the number of fragments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of fragments that are sent to the executors at a time.
BLOCK_BYTES = 8 << 20
_CUT = "\x1f"  # between tokens; no token holds it


def _automaton(block: list[tuple[str, int]]):
    """Values: the numbers of all fragments with these tokens, and how many tokens they have."""
    import ahocorasick

    out = ahocorasick.Automaton()
    values: dict[str, list[int]] = {}
    for text, number in block:
        values.setdefault(text, []).append(number)
    for text, numbers in values.items():
        out.add_word(f"{_CUT}{text}{_CUT}", (text.count(_CUT) + 1, numbers))
    out.make_automaton()
    return out


def _found(shared, n_keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in batches:
            rows, first, last, number = [], [], [], []
            for row, tokens in enumerate(batch.column(n_keep)):
                if not tokens.is_valid or not len(tokens):
                    continue
                text = f"{_CUT}{_CUT.join(t if t is not None else '' for t in tokens.as_py())}{_CUT}"
                cuts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord(_CUT))
                hits = list(automaton.iter(text))
                until = np.searchsorted(cuts, np.array([end for end, _ in hits], np.int64)) if hits else []
                for stop, (_, (size, numbers)) in zip(until, hits, strict=True):
                    for k in numbers:
                        rows.append(row)
                        first.append(int(stop) - size)
                        last.append(int(stop))
                        number.append(k)
            at = pa.array(rows, pa.int64())
            columns = [batch.column(i).take(at) for i in range(n_keep)]
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names)
            for i in range(0, len(whole), 1 << 16):
                yield whole.slice(i, 1 << 16)

    return run


def occurrences(docs: DataFrame, fragments: DataFrame, tokens: str, fragment: str, carry: list[str] | None = None) -> DataFrame:
    """One row an occurrence: the ``carry`` columns of ``docs`` (default: all but ``tokens``), ``fragment_no`` and the token span (first, last).

    ``fragments`` has ``fragment_no`` (bigint) and the array column ``fragment``. Occurrences may overlap, in a fragment's
    own ones too; equal fragments each have theirs; one without tokens has none, and so have null and empty documents. No
    token may hold the character U+001F. The driver holds one block of fragments at a time, each document is read once a block.
    """
    carry = [c for c in docs.columns if c != tokens] if carry is None else carry
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(tokens).alias("_tokens"))
    schema = docs.select(*[F.col(f"`{c}`") for c in carry], F.lit(0).cast("long").alias("fragment_no"), F.lit(0).alias("first"), F.lit(0).alias("last")).schema
    held = fragments.where(F.size(fragment) > 0).select("fragment_no", F.concat_ws(_CUT, fragment).alias("text"))
    parts, block, size = [], [], 0

    def close() -> None:
        shared = docs.sparkSession.sparkContext.broadcast(list(block))
        parts.append(rows.mapInArrow(_found(shared, len(carry), schema.names), schema))

    for row in held.toLocalIterator(prefetchPartitions=True):
        block.append((row["text"], row["fragment_no"]))
        size += len(row["text"]) + 16
        if size >= BLOCK_BYTES:
            close()
            block, size = [], 0
    if block:
        close()
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)
