"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled text recognises every substring of that text. A document is parsed
against it greedily: each phrase is the longest match that starts where the last one ended. A text of the same language
needs few, long phrases; phrases times log2 of the labelled length, by symbol, estimate the cross entropy, and the
language that needs least wins.

Symbols are the UTF-8 bytes of the lower-cased text; whatever is no letter (ASCII) becomes one space, runs of it too.
The automata become one dense transition table, and all segments of all documents of a batch walk through it in
lockstep against all languages at once, so that a very long text is many short lanes and not one long loop. A lane goes
on to the end of its last phrase, which is where the next one has to begin; lanes that began elsewhere are parsed again.
Where many lanes do not fit together after some rounds (repetitive text, whose phrases keep their phase), the longest
match of every place is taken from matching statistics, in steps linear in the text, and the phrases follow these jumps.
So the phrases are those of one parse of the whole text, however long they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.staging import with_body

#: Symbols of a lane, how often each lane may be parsed on average before all have to fit, and symbols of a lane of matching statistics.
SEGMENT, AGAIN, STRETCH = 256, 8, 1 << 12
#: The labelled sample: at most so many whole documents of a language, of so many bytes together (or one).
LABELLED_DOCUMENTS, LABELLED_BYTES = 60, 32_000
_SPACE = 32
_CODE = np.arange(256, dtype=np.uint8)
_CODE[:128] = _SPACE
_CODE[97:123] = np.arange(97, 123)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol bytes of lower-cased rows, runs of spaces as one; and the new offsets."""
    code = _CODE[data]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _SPACE) | (code[:-1] != _SPACE)
    inner = offsets[:-1][offsets[:-1] < len(code)]
    keep[inner] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], sums[offsets]


class SuffixAutomaton:
    """Transitions of the minimal automaton of all substrings of ``text`` (bytes)."""

    def __init__(self, text: bytes) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = link[at]
            if at >= 0:
                target = self.next[at][symbol]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at >= 0 and self.next[at].get(symbol) == target:
                        self.next[at][symbol] = copy
                        at = link[at]
                    link[target] = link[new] = copy
            last = new
        self.link, self.length = link, length


class Parser:
    """Automata of all languages in one table; entry = place of the next state's row, plus the phrases that end."""

    def __init__(self, labelled: dict[str, bytes]) -> None:
        self.languages = sorted(labelled)
        self.bits = np.array([math.log2(len(labelled[x]) + 2) for x in self.languages])
        known = sorted(set(b"".join(labelled.values())))
        self.column = np.ones(256, np.uint8)  # 0 stands still, 1 is a symbol that no labelled text has
        self.column[known] = np.arange(2, len(known) + 2)
        width = -(-(len(known) + 2) // 4) * 4
        tables, links, lengths, self.roots, base = [], [], [], [], 0
        self.width = width
        for language in self.languages:
            automaton = SuffixAutomaton(labelled[language])
            states = automaton.next
            root = base * width
            table = np.empty((len(states), width), np.int32)
            table[:] = root + 2  # the phrase ends, and so does the one of the unknown symbol
            for symbol, target in states[0].items():
                table[:, self.column[symbol]] = (base + target) * width + 1  # the phrase ends, the next one begins
            table[0, 1:] = root + 1
            rows = np.repeat(np.arange(len(states)), [len(x) for x in states])
            columns = self.column[np.fromiter((s for x in states for s in x), np.int64, len(rows))]
            table[rows, columns] = (base + np.fromiter((t for x in states for t in x.values()), np.int64, len(rows))) * width
            table[:, 0] = (base + np.arange(len(states))) * width
            tables.append(table)
            links.append((base + np.maximum(0, automaton.link)).astype(np.int32))
            lengths.append(np.array(automaton.length, np.int32))
            self.roots.append(root)
            base += len(states)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.link, self.length = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (links, lengths))

    def _walk(self, column: np.ndarray, root: np.ndarray, begin: np.ndarray, stop: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in [begin, stop) of many lanes, and where the one after them begins; ``end``: of the text."""
        size = np.maximum(0, stop - begin)
        order = np.argsort(-size, kind="stable")
        falling, at, home = -size[order], begin[order], root[order]
        state, count = home.copy(), np.zeros(len(order), np.int64)
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(falling, -step, side="left"))  # lanes longer than step
            entry = self.table.take(state[:n] + column[at[:n] + step])
            ended = entry & 3
            count[:n] += ended
            state[:n] = entry - ended
        after = np.maximum(at, stop[order])
        last = end[order]
        open_ones = np.flatnonzero(state != home)
        while len(open_ones):  # the last phrase, to its end
            over = after[open_ones] >= last[open_ones]
            count[open_ones[over]] += 1
            open_ones = open_ones[~over]
            entry = self.table.take(state[open_ones] + column[after[open_ones]])
            ended = (entry & 3) > 0
            count[open_ones[ended]] += 1
            state[open_ones] = entry - (entry & 3)
            open_ones = open_ones[~ended]
            after[open_ones] += 1
        out = np.empty_like(count), np.empty_like(after)
        out[0][order], out[1][order] = count, after
        return out

    def _jumps(self, column: np.ndarray, begin: np.ndarray, end: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a phrase that begins at each place of the texts [begin, end) ends: the longest match, or one unknown symbol;
        and where each text begins in the result.

        A lane holds the match that begins at ``i`` and ends before ``e``, in ``state``; it goes on by a symbol, or, if
        that is not known to follow, drops its first one by the automaton's suffix links. So a lane takes two steps a
        symbol, and one for each symbol of the match that leaves it. All lanes of all texts go in lockstep.
        """
        sizes = end - begin
        at = np.concatenate([[0], np.cumsum(sizes)])
        lanes = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(begin)), lanes)
        first = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRETCH
        out = np.zeros(at[-1], np.int64)
        i, e, last, stop = first.copy(), first.copy(), end[owner], np.minimum(first + STRETCH, end[owner])
        home, shift = (root[owner] // self.width).astype(np.int64), at[owner] - begin[owner]
        state = home.copy()
        while len(i):
            entry = self.table.take(state * self.width + column[np.minimum(e, last - 1)])
            on = (e < last) & (entry & 3 == 0)
            stay = ~on
            state[on] = entry[on] // self.width
            e[on] += 1
            here = i[stay]
            out[here + shift[stay]] = np.maximum(e[stay], here + 1)
            i[stay] = here + 1
            e[stay] = np.maximum(e[stay], here + 1)
            above = self.link[state]
            shorter = stay & (e - i <= self.length[above])
            state[shorter] = above[shorter]
            alone = stay & (e == i)
            state[alone] = home[alone]
            live = i < stop
            if not live.all():
                i, e, last, stop, home, shift, state = (x[live] for x in (i, e, last, stop, home, shift, state))
        return out, at

    def _followed(self, column: np.ndarray, begin: np.ndarray, end: np.ndarray, root: np.ndarray) -> list[int]:
        """Phrases of each text, jump by jump."""
        jumps, at = self._jumps(column, begin, end, root)
        counts = []
        for k in range(len(begin)):
            place, n, size = 0, 0, int(end[k] - begin[k])
            for low in range(0, size, 1 << 20):
                high = min(size, low + (1 << 20))
                part = (jumps[at[k] + low : at[k] + high] - begin[k]).tolist()
                while place < high:
                    place = part[place - low]
                    n += 1
            counts.append(n)
        return counts

    def phrases(self, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases by row and language."""
        rows, langs = len(offsets) - 1, len(self.languages)
        pieces = -(-np.diff(offsets) // SEGMENT)
        owner = np.repeat(np.arange(rows), pieces)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end = offsets[owner] + part * SEGMENT, offsets[owner + 1]
        stop = np.minimum(start + SEGMENT, end)
        column = np.append(self.column[code], 0).astype(np.int32)
        lanes = len(owner)
        root = np.repeat(np.array(self.roots, np.int32), lanes)
        begin, stop, end, first = np.tile(start, langs), np.tile(stop, langs), np.tile(end, langs), np.tile(part == 0, langs)
        count, after = np.zeros(langs * lanes, np.int64), np.zeros(langs * lanes, np.int64)
        todo = np.arange(langs * lanes)
        spent = 0
        while len(todo) and spent <= AGAIN * len(begin):
            spent += len(todo)
            count[todo], after[todo] = self._walk(column, root[todo], begin[todo], stop[todo], end[todo])
            wanted = np.where(first, begin, np.concatenate([begin[:1], after[:-1]]))
            todo = np.flatnonzero(wanted != begin)
            begin = wanted
        out = np.zeros((rows, langs))
        for k in range(langs):
            out[:, k] = np.bincount(owner, count[k * lanes : (k + 1) * lanes], minlength=rows)
        left = sorted({(lane // lanes, owner[lane % lanes]) for lane in todo.tolist()})
        if left:
            k, row = np.array(left).T
            out[row, k] = self._followed(column, offsets[row], offsets[row + 1], np.array(self.roots)[k])
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Parser:
    """Automata from a bounded sample of whole labelled documents: the first ones of each language by a hash of the id that
    fit into ``LABELLED_BYTES`` together; a language with none so short gives one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and id is not null and text is not null")
    sized = rows.select("id", "lang", F.octet_length("text").alias("size"))
    chance = Window.partitionBy("lang").orderBy(F.col("size") > LABELLED_BYTES, F.xxhash64(F.lit(3), "id"), "id", "size")
    first = sized.withColumn("rank", F.row_number().over(chance)).where(F.col("rank") <= LABELLED_DOCUMENTS)
    total = F.sum("size").over(Window.partitionBy("lang").orderBy("rank"))
    chosen = first.withColumn("total", total).where((F.col("total") <= LABELLED_BYTES) | (F.col("rank") == 1)).select("id", "lang", "size").distinct()
    same = rows.withColumn("size", F.octet_length("text")).join(F.broadcast(chosen), ["id", "lang", "size"]).select("lang", "id", "text").distinct()
    labelled: dict[str, list[str]] = {}
    for row in sorted(same.collect(), key=lambda r: (r["lang"], r["id"], r["text"])):
        labelled.setdefault(row["lang"], []).append(row["text"])
    texts = {}
    for language, own in labelled.items():
        code, _ = symbols(*K.column_bytes(pc.utf8_lower(pa.array([" ".join(own)], pa.string()))))
        if len(code):
            texts[language] = code.tobytes()
    return Parser(texts)


def _predict(shared, n_carry: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: Parser = shared.value
        for batch in batches:
            column = batch.column(n_carry)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, offsets = K.column_bytes(pc.utf8_lower(column))
            best, score = [], []
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                if not parser.languages:
                    best += [None] * (last - first)
                    score += [0.0] * (last - first)
                    continue
                cost = parser.phrases(*symbols(data[own[0] : own[-1]], own - own[0])) * parser.bits
                cost -= cost.min(1, keepdims=True)
                best += [parser.languages[k] for k in cost.argmin(1)]
                score += (1 / np.exp2(-np.minimum(cost, 1000)).sum(1)).tolist()
            best = [x if has and x is not None else "und" for x, has in zip(best, lettered, strict=True)]
            score = [0.0 if x == "und" else min(1.0, s) for x, s in zip(best, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_carry)] + [pa.array(best, pa.string()), pa.array(score, pa.float64())], names)

    return run


def identify(docs: DataFrame, parser: Parser, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns with ``lang_pred`` (``und`` for a null text and one without a letter) and ``score``, the
    share of the winner if each language had the probability 2 to the minus its parse's bits.

    Ties go to the first language by name; repeated rows get the same answer; an empty table gives an empty result;
    own columns named ``lang_pred`` or ``score`` are replaced.
    """
    carry = [c for c in docs.columns if c not in (text, "lang_pred", "score")] if carry is None else carry
    rows = with_body(docs, carry, text)
    schema = docs.select(*[f"`{c}`" for c in carry], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(parser), len(carry), schema.names), schema)


def query_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labelled text only from those whose checksum of the id leaves no remainder 2 by 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    parser = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), parser)
