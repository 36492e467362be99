"""Token counts by batch encoding in Arrow functions that return lengths only.

A text goes to the tokenizer as pieces of bounded size, cut where no token can cross, and the pieces of many texts are
encoded together in batches of about equal bytes. Only the number of tokens goes back to Spark. No row moves between
tasks: the scan's own splits, which are cut by bytes, are the tasks, and a text of a hundred megabytes is a hundred pieces.

Where the tokenizer drops white space, a cut there changes no token, so a batch is encoded word by word: each distinct
word once, and its length is added as often as it occurs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

#: Characters of a piece, bytes of a batch, and words (of at most so many characters) whose length a task remembers.
PIECE, BATCH_BYTES, KNOWN_WORDS, KNOWN_LENGTH = 1 << 18, 1 << 20, 200_000, 40

#: White space that every library takes for white space; longer kinds stay within the words.
BLANK = " \t\n\r\x0b\x0c"
_WORD = re.compile(f"[^{BLANK}]+")
#: Other safe places, for long words of a tokenizer that drops white space: between digits, and where a letter ends before one of these marks.
_WITHIN = re.compile(r"(?<=[0-9])(?=[0-9])|(?<=[A-Za-z一-鿿])(?=[.,;:!?、。，；：！？])")
#: One space between two letters: byte-level tokens may begin with it, and none ends with it or goes beyond.
_SPACE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def cut(text: str, place: re.Pattern[str], size: int, drop: bool) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at matches of ``place`` (which are left out if ``drop``); a
    stretch without one is one piece."""
    start = 0
    while len(text) - start > size:
        hit = place.search(text, start + size)
        if not hit:
            break
        yield text[start : hit.start()]
        start = hit.end() if drop else hit.start()
    yield text[start:] if start else text


class Lengths:
    """Token counts of texts by one tokenizer file (.json or .model), without begin, end or added special tokens."""

    def __init__(self, path: str, piece: int = PIECE, batch_bytes: int = BATCH_BYTES) -> None:
        self.piece, self.batch_bytes, self.known = piece, batch_bytes, {}
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]
            self.rule = "space dropped"  # every piece begins as a word after a space does
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self._encode = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as file:
                self.rule = _rule(json.load(file))

    def pieces(self, text: str) -> Iterator[str]:
        if self.rule == "words":
            for piece in cut(text, re.compile(f"[{BLANK}]"), self.piece, True):
                yield from cut(piece, _WITHIN, self.piece, False) if len(piece) > 2 * self.piece else (piece,)
        elif self.rule == "whole":
            yield text
        else:
            yield from cut(text, _SPACE, self.piece, self.rule == "space dropped")

    def encoded(self, texts: list[str]) -> list[int]:
        """Lengths of one batch of pieces."""
        if self.rule != "words":
            return self._encode(texts)
        words = [_WORD.findall(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        here = list(set().union(*words).difference(self.known))
        lengths = self.known
        if here:
            found = dict(zip(here, self._encode(here), strict=True))
            lengths = lengths | found if any(len(w) > KNOWN_LENGTH for w in here) else None
            self.known.update((w, n) for w, n in found.items() if len(w) <= KNOWN_LENGTH)
        lengths = self.known if lengths is None else lengths
        return [sum(map(lengths.__getitem__, w)) for w in words]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text (null: none), the pieces taken in batches of about ``batch_bytes``."""
        out, rows, batch, held = [0] * len(texts), [], [], 0

        def flush() -> None:
            for row, n in zip(rows, self.encoded(batch), strict=True):
                out[row] += n
            rows.clear()
            batch.clear()

        for row, text in enumerate(texts):
            for piece in self.pieces(text) if text else ():
                rows.append(row)
                batch.append(piece)
                held += len(piece.encode())
                if held >= self.batch_bytes:
                    flush()
                    held = 0
        if batch:
            flush()
        return out


def _rule(spec: dict) -> str:
    """Where texts may be cut, by the file's own description; an unknown kind is encoded whole."""
    parts = lambda x: (x or {}).get("pretokenizers") or (x or {}).get("normalizers") or ([x] if x else [])
    before, plain = parts(spec.get("pre_tokenizer")), {"NFC", "Lowercase", "Replace"}
    normal = parts(spec.get("normalizer"))
    stripped = any(t.get("lstrip") or t.get("rstrip") or set(t["content"]) & set(BLANK) for t in spec.get("added_tokens") or [])
    if stripped or not all(n["type"] in plain and (n["type"] != "Replace" or n.get("content") == " ") for n in normal):
        return "whole"
    split = next((p for p in before if p["type"] == "Split"), None)
    if split and split.get("invert") and split.get("behavior") == "Removed" and "[^\\s\\p{L}\\p{N}]+" in str(split["pattern"].get("Regex")) and " ?" not in str(split["pattern"].get("Regex")):
        return "words"
    if [p["type"] for p in before] == ["ByteLevel"] and before[0].get("use_regex", True) and not before[0].get("add_prefix_space") and not normal:
        return "space kept"
    return "whole"


@lru_cache(maxsize=4)
def _lengths(path: str, piece: int, batch_bytes: int) -> Lengths:
    return Lengths(path, piece, batch_bytes)


def token_count(path: str, piece: int = PIECE, batch_bytes: int = BATCH_BYTES) -> Callable[[Column], Column]:
    """A column function: the number of tokens of a text. ``path`` is the tokenizer file, the same on every executor."""

    @arrow_udf("long", ArrowUDFType.SCALAR_ITER)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths = _lengths(path, piece, batch_bytes)
        for batch in batches:
            out = []
            for first in range(0, len(batch), 256):  # texts become Python strings a few at a time
                out += lengths.count(batch.slice(first, 256).to_pylist())
            yield pa.array(out, pa.int64())

    return count


def with_token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    Whole texts are counted, however long; null and empty texts have no bytes and no tokens. Repeated rows are counted
    each, an empty table gives an empty result, and columns of these three names are replaced. Strings of special tokens
    within a text count as the library takes them by default.
    """
    tokens = token_count(path)(F.col(f"`{text}`"))
    sized = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    return docs.withColumns({"n_bytes": sized, "n_tokens": tokens}).withColumn("over_limit", F.col("n_tokens") > limit)


def query_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, counted by the word vocabulary of 49 thousand entries."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
