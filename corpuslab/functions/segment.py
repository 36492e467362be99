"""Paragraphs, sentences and words as rows with explicit keys (doc_id, para_no, sent_no, word_no)."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T

#: Where a sentence ends: an end mark, space, and a capital of any alphabet or a digit behind it, perhaps quoted.
SENTENCE_GAP = r"(?<=[.!?…;:])\s+(?=[«\"(]?[\p{Lu}0-9])"
#: The same without colons and semicolons.
STRICT_GAP = r"(?<=[.!?…])\s+(?=[«\"(]?[\p{Lu}0-9])"
#: Abbreviations whose full stop does not end a sentence, of Russian and of other languages.
ABBREVIATIONS = [
    "т", "е", "д", "п", "г", "гг", "ст", "пп", "ч", "им", "рис", "табл", "см", "др", "руб", "тыс", "млн", "млрд", "стр", "ул", "кв", "тел", "прим", "вып", "гл", "разд", "подп", "абз", "обл", "корп", "пер", "проф", "акад", "доц", "канд", "экз", "шт", "коп", "мин", "сек", "изд", "т.е", "т.д", "т.п", "т.к", "т.н", "н.э", "и.о",
    "e.g", "i.e", "etc", "vs", "cf", "fig", "no", "vol", "dr", "mr", "mrs", "ms", "st", "bzw", "z.b", "d.h", "usw", "nr", "art", "av", "p.ex", "sr", "sra", "ej",
]
#: A run between spaces that may end a sentence: what it says, its end marks, and marks that close a quote or bracket.
_CLOSED = regex.compile(r"(?P<stem>.*?)(?P<marks>[.!?…]+)[»\")\]”]*", regex.DOTALL)
_BEGINS = regex.compile(r"[«\"(“]?[\p{Lu}\d]")
#: Kinds of stems, tried in this order: numbers and letters of a list (if they are all that the sentence has), single letters.
_KINDS = [("label", regex.compile(r"\d+(?:\.\d+)*\.?|\p{Ll}\)|[IVXLC]+\.?")), ("letters", regex.compile(r"[«\"(“]*(?:\w\.)*\w"))]
#: Whether a sentence ends behind a stem of some kind: after one full stop, after other marks.
_ENDS = {"label": (False, False), "short": (False, True), "letters": (False, True), "word": (True, True)}


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a paragraph: ``para_no`` and ``par``; other columns stay."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(F.col(text), r"\n+")).alias("para_no", "par"))


def sentences(docs: DataFrame, text: str = "text", gap: str = SENTENCE_GAP) -> DataFrame:
    """One row a sentence by the plain splitter, which cuts at every ``gap``."""
    pars = paragraphs(docs, text)
    keep = [c for c in pars.columns if c != "par"]
    one_line = F.trim(F.regexp_replace("par", r"\s+", " "))
    return pars.select(*keep, F.posexplode(F.split(one_line, gap)).alias("sent_no", "sentence"))


def word_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a word: ``word_no`` and ``word``."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(T.words(F.col(text))).alias("word_no", "word"))


def _kind(stem: str, alone: bool, abbreviations: frozenset[str]) -> str:
    """What stands before end marks; ``alone`` if the sentence has nothing else."""
    for name, form in _KINDS:
        if (alone or name != "label") and form.fullmatch(stem):
            return name
    return "short" if stem.lstrip("«\"(“").lower() in abbreviations else "word"


def exact_spans(text: str, abbreviations: frozenset[str] = frozenset(ABBREVIATIONS)) -> list[tuple[int, int]]:
    """Sentence spans of one paragraph in code points, without the space around them: a capital or digit follows an end;
    abbreviations, initials and numbered headings do not end one, closing marks stay with theirs.

    The paragraph is a row of runs between spaces. Each run but the last is looked up by its kind and marks, and the cuts
    behind the runs that end a sentence give the spans."""
    runs = [(m.start(), m.end(), m[0]) for m in regex.finditer(r"\S+", text)]
    spans, first = [], 0
    for k, (_, end, run) in enumerate(runs):
        closed = _CLOSED.fullmatch(run)
        last = k + 1 == len(runs)
        if closed and not last and _BEGINS.match(runs[k + 1][2]):
            stem = closed["stem"] or (runs[k - 1][2] if k > first else "")
            words = k - first + bool(closed["stem"])  # of the sentence so far
            last = _ENDS[_kind(stem, words == 1, abbreviations)][closed["marks"] != "."]
        if last:
            spans.append((runs[first][0], end))
            first = k + 1
    return spans


def sentence_spans(text: Column | str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"start": a, "end": b} for a, b in exact_spans(t)])

    return F.pandas_udf(run, "array<struct<start:int,end:int>>")(text)


def exact_sentences(df: DataFrame, text: str) -> DataFrame:
    """Rows with ``sent_no``, ``start``, ``end`` (code points) and ``sentence``; other columns stay."""
    keep = [c for c in df.columns if c != text]
    spans = df.withColumn("_spans", sentence_spans(text))
    out = spans.select(*keep, text, F.posexplode("_spans").alias("sent_no", "_s"))
    cut = F.substring(F.col(text), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
    return out.select(*keep, "sent_no", "_s.start", "_s.end", cut.alias("sentence"))


def length_bucket(n: Column) -> Column:
    """Sentence length classes."""
    return F.when(n < 8, "<8").when(n <= 15, "8-15").when(n <= 25, "16-25").when(n <= 40, "26-40").otherwise(">40")


def paragraph_kind(in_table: Column, style: Column, marker: Column) -> Column:
    """table before heading before list before body."""
    return F.when(in_table, "table").when(F.lower(style).startswith("heading"), "heading").when(marker != "", "list").otherwise("body")
