"""Normalisation and token columns. Every function takes and returns columns, so Catalyst sees through it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:[-‑][\p{L}\p{N}]+)*"
#: Characters that the normal form replaces, and their replacements.
FOLD_FROM, FOLD_TO = "ёЁ–—−«»„“”", "еЕ---\"\"\"\"\""


def normal(text: Column) -> Column:
    """Folded letters, dashes and quotes, initials pulled together, single spaces."""
    out = F.translate(text, FOLD_FROM, FOLD_TO)
    out = F.regexp_replace(out, r"(\p{Lu}\.) (\p{Lu}\.)", "$1$2")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def match_key(text: Column) -> Column:
    """Lower-case words joined by single spaces: equal for texts that differ in case, punctuation or space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{N}_]+", " "))


def words(text: Column) -> Column:
    """Array of words; a hyphen inside joins."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), 0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is empty."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def count_of(text: Column, piece: str) -> Column:
    """How often a string occurs, without a regex."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def list_marker(text: Column) -> Column:
    """The list marker at the beginning (number, letter or bullet), with the space behind it."""
    return F.regexp_extract(text, r"^(\s*(?:\d+(?:\.\d+)*[.)]|\p{L}[)]|[-•*])\s+)", 1)


def protected(word: Column) -> Column:
    """Words that no correction may touch: digits, two capitals or more."""
    return word.rlike("[0-9]") | (F.regexp_count(word, F.lit(r"\p{Lu}")) >= 2)


def strip_markup(html: Column) -> Column:
    """Scripts, styles and tags removed, the common character references decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text
