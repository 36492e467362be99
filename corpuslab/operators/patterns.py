"""Patterns over rows of words: a unit's part-of-speech tags as one string, one character a word, and regular expressions on it.

This is what MATCH_RECOGNIZE does over ordered rows, without a window or a self-join: the tags of a unit are one value,
a pattern is a regular expression, and a place in the string is the number of a word. Contexts of a word look at a
bounded piece of the string before and behind it, so they cost the same in a sentence and in a document of a million words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.once import computed
from corpuslab.operators import morphology

#: Tags by part of speech. Short adjectives (J) are adjectives to their neighbours, short participles (S) verbs.
TAGS = {
    "NOUN": "N", "NPRO": "O", "ADJF": "A", "ADJS": "J", "PRTF": "F", "PRTS": "S", "NUMR": "U", "NUM": "U", "VERB": "V", "INFN": "I",
    "GRND": "G", "ADVB": "D", "COMP": "D", "PRED": "D", "PREP": "R", "CONJ": "C", "PRCL": "T", "LATIN": "L", "OTHER": "X",
}
MATCH = "array<struct<pattern:string,first:int,last:int,parts:array<struct<name:string,first:int,last:int>>>>"
#: Characters of the tag string that a context looks back and ahead.
REACH = 10


def tag(pos: Column) -> Column:
    """The character of a part of speech."""
    named = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return F.coalesce(named[pos], F.lit(TAGS["OTHER"]))


def tag_strings(words: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, tags) of units from word rows (keys, word_no, word): every word's tag by its best parse in ``lexicon``."""
    tagged = morphology.coarse_pos(words, lexicon)
    rows = tagged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("word_no", "word", tag(F.col("pos")).alias("t")))).alias("w"))
    return rows.select(*keys, F.col("w.word").alias("words"), F.concat_ws("", "w.t").alias("tags"))


def matches(tags: Column | str, patterns: dict[str, str], overlapping: bool = False) -> Column:
    """All matches of each pattern, as (pattern, first, last, parts): word numbers from 0, ``last`` exclusive; ``parts``
    are the named groups that took part. A match begins behind the one before, or, if ``overlapping``, at every word where
    one can begin. Null tags give no matches; empty matches are left out."""
    compiled = {name: regex.compile(pattern) for name, pattern in patterns.items()}

    def found(text: str) -> Iterator[dict]:
        for name, pattern in compiled.items():
            for m in pattern.finditer(text, overlapped=overlapping):
                if m.end() > m.start():
                    parts = [{"name": g, "first": m.start(g), "last": m.end(g)} for g in sorted(pattern.groupindex, key=pattern.groupindex.get) if m.start(g) >= 0]
                    yield {"pattern": name, "first": m.start(), "last": m.end(), "parts": parts}

    part = pa.struct([("name", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
    kind = pa.list_(pa.struct([("pattern", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("parts", pa.list_(part))]))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([list(found(t or "")) for t in column.to_pylist()], kind)

    return F.arrow_udf(run, MATCH)(tags)


def matched(units: DataFrame, tags: str, patterns: dict[str, str], overlapping: bool = False) -> DataFrame:
    """One row a match: the columns of ``units`` with ``pattern``, ``first``, ``last`` and ``parts``."""
    return units.withColumn("_m", F.explode(matches(F.col(tags), patterns, overlapping))).select(*units.columns, "_m.*")


def word_tags(units: DataFrame, tags: str) -> DataFrame:
    """One row a word: the other columns, ``at`` (from 0), ``tag``, and the tags ``before`` and ``after`` it, ``REACH`` at most."""
    keep = [c for c in units.columns if c != tags]
    rows = computed(units.where(F.length(tags) > 0), _t=F.split(F.col(tags), ""))
    piece = lambda first, size: F.array_join(F.slice("_t", first, size), "")
    around = lambda t, i: F.struct(i.alias("at"), t.alias("tag"), piece(F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH))).alias("before"), piece(i + 2, F.lit(REACH)).alias("after"))
    rows = rows.select(*keep, F.explode(F.transform("_t", around)).alias("_w"))
    return rows.select(*keep, "_w.*")


def _length(text: Column, pattern: str) -> Column:
    """Characters of the match of a pattern, 0 without one."""
    return F.length(F.regexp_extract(text, pattern, 0))


def form_context(tag_: Column, before: Column, after: Column) -> Column:
    """Struct (ctx, dist): what a word's form depends on, and how many words away that stands (0: nothing near).

    A noun looks left over adjectives and numerals to a preposition, then at its neighbours; an adjective or participle
    looks right for its noun over other modifiers, else left for one; a predicate looks left for its subject.
    """
    out = lambda name, dist: F.struct(F.lit(name).alias("ctx"), dist.cast("int").alias("dist"))
    governed, head = _length(before, "R[AJFU]{0,5}$"), _length(F.left(after, F.lit(6)), "^[AJFUCD]{0,5}N")
    back, subject = _length(before, "N[^N]{0,6}$"), _length(before, "[NO][^NO]{0,7}$")
    one, none = F.lit(1), F.lit(0)
    noun = (
        F.when(governed > 0, out("after_preposition", governed))
        .when(before.rlike("U$"), out("after_numeral", one))
        .when(before.rlike("[AJF]$"), out("noun_after_adj", one))
        .when(before.rlike("N$"), out("noun_noun_chain", one))
        .when(before.rlike("[VS]$"), out("verb_object", one))
        .when(before.rlike("[VS].$"), out("verb_object", F.lit(2)))
        .otherwise(out("other", none))
    )
    modifier = F.when(head > 0, out("adj_noun_agreement", head)).when(back > 0, out("participle_after_noun", back)).otherwise(out("adj_no_head_right", none))
    return F.when(tag_.isin("N", "O"), noun).when(tag_.isin("A", "F"), modifier).when(tag_.isin("V", "S", "J"), out("predicate", subject)).otherwise(out("other", none))


def distance_class(dist: Column) -> Column:
    return F.when(dist <= 2, dist.cast("string")).when(dist <= 4, "3-4").otherwise("5+")
