"""Licence scans: winnowed template fingerprints in an inverted index, then banded alignment.

Templates are cut into words, runs of three words are hashed, and winnowing keeps the smallest hash of every window of
runs: these fingerprints point to their template and place. All runs of a document are looked up in this index; hits on
about the same diagonal are a candidate. A candidate is aligned word by word with its template within a band around the
diagonal (local alignment, match 1, mismatch and gap -1/2), which tells the matched words, the coverage of the template
and the span in the document. Of overlapping candidates the one with most matched words stays.

Runs miss altered short templates, so each template also has guards: one word more than may be missing of it, the rarest
first. Of any alignment with enough matched words, at least one guard is matched; it is a candidate if enough words of the
template stand near it. So every alignment that drifts by no more than the band is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.staging import with_body

RUN, WINDOW = 3, 4
#: Words that are guards only if there are no others.
COMMON = "a all an and any are as at be but by can for from has have if in is it its may more must no not of on one or other that the this to under use was where will with work you your"

#: Notices of public licences, as their stewards word them, and the usual one-line references.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window (the last of equals); fewer hashes than a window are one window."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], 1))


class Postings:
    """Key -> (template, place), sorted by key."""

    def __init__(self, found: list[tuple[int, int, int]]) -> None:
        found = sorted(found)
        self.key = np.array([x[0] for x in found], np.uint64)
        self.template, self.place = (np.array([x[k] for x in found], np.int64) for k in (1, 2))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.key >> np.uint64(48)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, entry of the index) of every hit."""
        maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(48)).astype(np.int64)])
        first, last = np.searchsorted(self.key, hashes[maybe], "left"), np.searchsorted(self.key, hashes[maybe], "right")
        many = last - first
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        return np.repeat(maybe, many), entry


class Index(Postings):
    """Winnowed fingerprints of the templates; ``guards``: words of which one is in every alignment of ``least`` of a template."""

    def __init__(self, templates: list[tuple[str, str]], least: float = 0.8) -> None:
        self.names = [name for name, _ in templates]
        data, offsets = K.column_bytes(pa.array([text for _, text in templates] + [COMMON], pa.string()))
        words = K.Words(data, offsets, K.ALNUM_WORDS)
        *self.words, common = [words.hash[words.bounds[i] : words.bounds[i + 1]] for i in range(len(templates) + 1)]
        super().__init__([(int(h[p]), t, int(p)) for t, own in enumerate(self.words) for h in [K.sequence_hash(own, min(RUN, len(own)))] for p in winnow(h, WINDOW)])
        guards = []
        for t, own in enumerate(self.words):
            size = (words.end - words.start)[words.bounds[t] : words.bounds[t + 1]]
            rare = np.lexsort((np.arange(len(own)), -size, np.isin(own, common)))
            guards += [(int(own[p]), t, int(p)) for p in rare[: max(0, len(own) - needed(least, len(own)) + 1)]]
        self.guards = Postings(guards)


def needed(least: float, size: int) -> int:
    """How many words of a template of ``size`` words count as enough."""
    return max(1, int(np.ceil(least * size)))


def align(text: list[int], template: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment within ``band`` of the diagonal: (matched words, first word, end word) in ``text``.

    ``diagonal`` is the place in the text that faces word 0 of the template."""
    before: dict[int, tuple[float, int, int]] = {}
    best = (0.0, 0, 0, 0)
    for i, word in enumerate(template):
        now: dict[int, tuple[float, int, int]] = {}
        left: tuple[float, int, int] | None = None
        for j in range(max(0, diagonal + i - band), min(len(text), diagonal + i + band + 1)):
            up, cross = before.get(j), before.get(j - 1)
            if text[j] == word:
                cell = (cross[0] + 1, cross[1] + 1, cross[2]) if cross and cross[0] > 0 else (1.0, 1, j)
            else:
                cell = max(((c[0] - 0.5, c[1], c[2]) for c in (cross, up, left) if c and c[0] > 0.5), default=(0.0, 0, j))
            now[j] = left = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        before = now
    return best[1], best[2], best[3]


def near_enough(words: np.ndarray, template: np.ndarray, places: np.ndarray, need: int, band: int) -> np.ndarray:
    """Which ``places`` lie in a stretch of ``words`` that an alignment can span and that holds ``need`` words of the template."""
    at = np.flatnonzero(np.isin(words, template))
    reach = len(template) - 1 + band
    begin = at[: max(0, len(at) - need + 1)]
    begin = begin[at[need - 1 :] - begin <= reach]
    last = np.searchsorted(begin, places, "right") - 1
    return (last >= 0) & (places - begin[last] <= reach) if len(begin) else np.zeros(len(places), bool)


def alignments(text: list[int], template: list[int], low: int, high: int, diagonal: int, band: int, need: int) -> list[tuple[int, int, int]]:
    """The best alignment in ``text[low:high]`` if it has ``need`` words, and those beside it: (matched words, first word, end word)."""
    if high - low < need:
        return []
    matched, first, end = align(text[low:high], template, diagonal - low, band)
    if matched < need:
        return []
    beside = [x for a, b in ((low, low + first), (low + end, high)) for x in alignments(text, template, a, b, diagonal, band, need)]
    return [(matched, low + first, low + end), *beside]


def scan_row(words: np.ndarray, places: np.ndarray, entries: np.ndarray, index: Index, least: float, guards: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """(template, first word, end word, matched words) of one document, without overlaps. ``guards``: hits of guards, if known."""
    found = []
    text: list[int] | None = None
    single, of = index.guards.look_up(words) if guards is None else guards
    for t in np.unique(np.concatenate([index.template[entries], index.guards.template[of]])):
        own, alone = index.template[entries] == t, index.guards.template[of] == t
        template = index.words[t]
        band, need = max(4, len(template) // 8), needed(least, len(template))
        diagonals = places[own] - index.place[entries[own]]
        if alone.any():
            near = near_enough(words, template, single[alone], need, band)
            diagonals = np.concatenate([diagonals, (single[alone] - index.guards.place[of[alone]])[near]])
        if not len(diagonals):
            continue
        diagonals = np.sort(diagonals)
        groups = np.split(diagonals, np.flatnonzero(np.diff(diagonals) > band) + 1)
        for group in groups:
            text = words.tolist() if text is None else text
            low = max(0, int(group[0]) - band)
            high = min(len(text), int(group[-1]) + len(template) + band)
            for matched, first, end in alignments(text, template.tolist(), low, high, int(group[len(group) // 2]), band + int(group[-1] - group[0]), need):
                found.append((matched, matched / len(template), int(t), first, end))
    found.sort(key=lambda x: (-x[0], -x[1], x[3], x[2]))
    kept: list[tuple[int, int, int, int]] = []
    for matched, _, t, first, end in found:
        if all(end <= k[1] or first >= k[2] for k in kept):
            kept.append((t, first, end, matched))
    return sorted(kept, key=lambda x: x[1])


def _scan(index: Index, least: float, n_carry: int, names: list[str], span: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(n_carry))
            spans: list[list[dict]] = []
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                words = K.Words(data[own[0] : own[-1]], own - own[0], K.ALNUM_WORDS)
                row_of = np.repeat(np.arange(words.rows), words.count)
                places, entries = index.look_up(K.sequence_hash(words.hash, RUN))
                inside = row_of[places] == row_of[np.minimum(places + RUN - 1, max(0, len(row_of) - 1))] if len(places) else np.zeros(0, bool)
                places, entries = places[inside], entries[inside]
                cuts = np.searchsorted(places, words.bounds)
                single, of = index.guards.look_up(words.hash)
                marks = np.searchsorted(single, words.bounds)
                for i in range(words.rows):
                    if cuts[i] == cuts[i + 1] and marks[i] == marks[i + 1]:
                        spans.append([])
                        continue
                    base = words.bounds[i]
                    part, alone = slice(cuts[i], cuts[i + 1]), slice(marks[i], marks[i + 1])
                    found = scan_row(words.hash[base : words.bounds[i + 1]], places[part] - base, entries[part], index, least, (single[alone] - base, of[alone]))
                    at = words.offsets[i]
                    spans.append([{"license": index.names[t], "start": int(words.start[base + a] - at), "end": int(words.end[base + b - 1] - at), "matched": m, "coverage": round(m / len(index.words[t]), 6)} for t, a, b, m in found])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_carry)] + [pa.array(spans, span)], names)

    return run


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, templates: list[tuple[str, str]] | None = None, least: float = 0.8, column: str = "licenses") -> DataFrame:
    """The ``carry`` columns and ``column``: array of (license, start, end, matched, coverage), by start.

    ``start`` and ``end`` are UTF-8 byte offsets; a template counts from ``least`` of its words on. Null and empty
    texts have none; repeated rows get the same answer; of overlapping matches the longer one stays; an empty table gives
    an empty result; an own column named like ``column`` is replaced.
    """
    carry = [c for c in docs.columns if c not in (text, column)] if carry is None else carry
    rows = with_body(docs, carry, text)
    kind = "array<struct<license:string,start:bigint,end:bigint,matched:bigint,coverage:double>>"
    schema = docs.select(*[f"`{c}`" for c in carry], F.lit(None).cast(kind).alias(column)).schema
    span = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))
    return rows.mapInArrow(_scan(Index(templates or TEMPLATES, least), least, len(carry), schema.names, span), schema)


def query_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the licences named in them, comma-joined and sorted, and the spans."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",")
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_spans"), names.alias("license_ids"), F.coalesce(F.array_max(F.col("licenses.coverage")), F.lit(0.0)).alias("coverage"), F.col("licenses").alias("spans"))
