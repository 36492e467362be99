"""Sentence and document filters, with reasons for what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def checkable(s: Column, least_words: int = 5, most_words: int = 60, letter_share: float = 0.6, digit_share: float = 0.15, script: str = r"\p{L}", foreign: str | None = None, foreign_share: float = 0.1, marks: str = "|=") -> Column:
    """A sentence fit for checking: of a usual length, mostly letters of ``script``, few of a ``foreign`` one and few digits,
    no table remains (``marks``), an end mark."""
    n = F.size(F.split(F.trim(s), " "))
    solid = F.length(F.replace(s, F.lit(" "), F.lit("")))
    plain = ~(s.contains("\t") | s.contains("...."))
    for mark in marks:
        plain = plain & ~s.contains(mark)
    own = F.regexp_count(s, F.lit(script))
    if foreign:
        plain = plain & (T.share(F.regexp_count(s, F.lit(foreign)), T.letters(s)) <= foreign_share)
    return n.between(least_words, most_words) & (T.share(own, solid) >= letter_share) & (T.share(F.regexp_count(s, F.lit("[0-9]")), solid) <= digit_share) & plain & F.right(s, F.lit(1)).isin(*".!?…:;")


def balanced(s: Column) -> Column:
    """Quotes and brackets in pairs."""
    pairs = [T.count_of(s, a) == T.count_of(s, b) for a, b in (("«", "»"), ("(", ")"), ("[", "]"))]
    out = T.count_of(s, '"') % 2 == 0
    for p in pairs:
        out = out & p
    return out


def drop_reason(s: Column) -> Column:
    """The first reason that applies to a sentence by itself, or ``kept``."""
    n, size = T.word_count(s), F.length(s)
    solid = F.length(F.replace(s, F.lit(" "), F.lit("")))
    return (
        F.when((n < 5) | (size < 25), "short")
        .when((n > 60) | (size > 400), "long")
        .when(T.share(T.letters(s), solid) < 0.8, "letters")
        .when(s.contains("|") | s.contains("="), "mark")
        .when(~balanced(s), "unbalanced")
        .otherwise("kept")
    )


def changed_share(a: Column, b: Column) -> Column:
    """Edit distance by the longer text: 0 for equal texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.levenshtein(a, b) / longer).otherwise(0.0)


def unknown_words(words: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Units (``keys``) that hold no word outside the lexicon; the lexicon is joined on distinct words only."""
    unknown = words.select(F.lower("word").alias("word")).distinct().join(lexicon.select("word"), "word", "left_anti")
    bad = words.select(*keys, F.lower("word").alias("word")).join(unknown, "word", "left_semi").select(*keys).distinct()
    return words.select(*keys).distinct().join(bad, keys, "left_anti")
