"""Rule packs as data: each rule is a pattern over the sentence that yields findings (start, end, rank, rule, fix).

A pattern is matched by the regex engine of the JVM, so a pack runs inside the plan. Rules that need more than a pattern
(neighbours, the vocabulary, the document) are written as joins and windows below.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import cleaning as C
from corpuslab.functions import text as T
from corpuslab.functions.once import computed


@dataclass(frozen=True)
class Rule:
    """``pattern`` has the whole finding as its match; ``fix`` is a replacement with $1 for groups, None for no suggestion."""

    name: str
    level: str
    pattern: str
    fix: str | None
    outside_quotes: bool = False
    script: str | None = None  # a look for what the pattern cannot match without


#: Runs of marks that no text needs.
MARK_RUN = Rule("MARK_RUN", "check", r"[%$*&#!|]{2,}", "")
LEVELS = {"strict": 1, "check": 2, "error": 3}
#: Language-neutral rules.
NEUTRAL = [
    Rule("DOUBLE_WORD", "error", r"(?iU)\b(\p{L}{2,}) \1\b", "$1"),
    Rule("GLUED_DIGIT", "error", r"(?<![\p{L}\p{N}])(\p{L}{3,})(\d+)(?![\p{L}\p{N}])", "$1 $2", script=r"\p{L}\d"),
    Rule("DOUBLE_SPACE", "check", r"(?<=\S)  +(?=\S)", " "),
    Rule("SPACE_BEFORE_MARK", "check", r"(?<=\p{L}) +([,.;])", "$1"),
]
#: Spelling of Russian particles and prepositions that are written with a hyphen or as one word.
RUSSIAN = [
    Rule("DEFIS_PARTICLE", "error", r"(?iU)\b(кто|кого|кому|кем|ком|что|чего|чему|чем|где|куда|когда|откуда|почему|зачем|чей|чья|чье|чьи|какой|какая|какое|какие|какого|какому|каким|какую|каких|какими) (то|либо|нибудь)\b", "$1-$2"),
    Rule("DEFIS_PARTICLE", "error", r"(?iU)\b(как) (либо|нибудь)\b", "$1-$2"),
    Rule("DEFIS_KOE", "error", r"(?iU)\b(кое|кой) (кто|что|где|куда|когда|какой|какие)\b", "$1-$2"),
    Rule("IZ_ZA", "error", r"(?iU)\b(из) (за|под)\b", "$1-$2"),
    Rule("IH_NIH", "error", r"(?iU)\bих них\b", "из них"),
    Rule("TAKZHE", "error", r"(?iU)(?<=^|[.!?]\s|[\s,]а\s)\b(так) (же)\b(?!\s*[,.;:)]|\s*$)(?![^.]{0,80}\bкак\b)", "$1$2"),
    Rule("TAKZHE", "check", r"(?iU)(?<!^|[.!?]\s|[\s,]а\s)\b(так) (же)\b(?!\s*[,.;:)]|\s*$)(?![^.]{0,80}\bкак\b)", "$1$2"),
    Rule("LOCAL_NET", "error", r"(?iU)\b(локальн)о-(вычислительн)(ая|ой|ую|ою)\b", "$1$3 $2$3"),
    Rule("NUM_ADJ", "error", r"(?iU)\b(\d+) ((?:часов|дневн|кратн|этажн|процентн|месячн|минутн|метров)(?:ый|ой|ая|ое|ые|ого|ому|ым|ом|ую|ых|ыми)|летн(?:ий|яя|ее|ие|его|ему|им|ем|юю|их|ими))\b", "$1-$2"),
    Rule("ABOVE_JOIN", "error", r"(?iU)\b(выше|ниже) (указанн\p{L}+|перечисленн\p{L}+|изложенн\p{L}+)", "$1$2"),
]
RUSSIAN = [replace(rule, script="[А-Яа-яЁё]") for rule in RUSSIAN]
LATIN_LIKE, CYRILLIC_LIKE = "aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ"


def _starts(parts: pa.Array, hits: pa.Array) -> pa.Array:
    """From the lengths of the parts between matches and of the matches, where each match starts."""
    n = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (parts, hits)]
    part, hit = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (parts, hits))
    row = np.repeat(np.arange(len(n[1])), n[1])
    within = np.arange(len(hit)) - np.repeat(np.cumsum(n[1]) - n[1], n[1])
    first = (np.cumsum(n[0]) - n[0])[row]  # the part before the first match of the row
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (part, hit)]
    start = sums[0][first + within + 1] - sums[0][first] + sums[1][np.arange(len(hit))] - sums[1][np.arange(len(hit)) - within]
    offsets = np.concatenate([[0], np.cumsum(n[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(start.astype(np.int32)))


@lru_cache(maxsize=1)
def _places() -> Callable[[Column, Column], Column]:
    """Arrow function over :func:`_starts`."""

    def run(parts: pa.Array, hits: pa.Array) -> pa.Array:
        return _starts(parts, hits)

    return F.arrow_udf(run, "array<int>")


def applies(text: Column, rule: Rule) -> Column:
    """Whether a text has a match of the rule."""
    return text.rlike(rule.pattern) if rule.script is None else text.rlike(rule.script) & text.rlike(rule.pattern)


def _fix(rule: Rule) -> Callable[[Column], Column]:
    """What replaces a match."""
    if rule.fix is None:
        return lambda h: F.lit(None).cast("string")
    return (lambda h: F.regexp_replace(h, _bare(rule.pattern), rule.fix)) if "$" in rule.fix else (lambda h: F.lit(rule.fix))


def pattern_spans(text: Column, rule: Rule) -> Column:
    """Array of the rule's findings (start, end, rank, rule, fix) in a text, by start: matches by the JVM, their places by
    prefix sums over lengths, all in the row. A text without the rule's script or without a match costs one look."""
    none = F.array().cast("array<string>")
    some = applies(text, rule)
    every = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    length = lambda x: F.length(x)
    starts = _places()(F.transform(F.when(some, F.split(text, rule.pattern, -1)).otherwise(none), length), F.transform(F.when(some, every).otherwise(none), length))
    hits = F.when(F.size(starts) > 0, every).otherwise(none)
    fix = _fix(rule)
    one = lambda h, a: F.struct(a.alias("start"), (a + F.length(h)).cast("int").alias("end"), F.lit(LEVELS[rule.level]).alias("rank"), F.lit(rule.name).alias("rule"), fix(h).alias("fix"))
    return F.zip_with(hits, starts, one)


@lru_cache(maxsize=1)
def _all_places() -> Callable[[Column, Column], Column]:
    """The same for the lists of several rules at once: one call a row, whatever the number of rules."""

    def run(parts: pa.Array, hits: pa.Array) -> pa.Array:
        flat = _starts(parts.flatten(), hits.flatten())
        sizes = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)

    return F.arrow_udf(run, "array<array<int>>")


def _hits(text: Column, rules: list[Rule]) -> Column:
    """Array of (k, parts, hits, fixes) of the rules that apply: lengths of what stands between the matches, the matches, and
    their fixes. Each rule looks at the text once; only one that has a match takes it apart."""
    kind = "array<struct<k:int,parts:array<int>,hits:array<string>,fixes:array<string>>>"
    groups: dict[str | None, list[Column]] = {}
    for k, rule in enumerate(rules):
        every = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
        lengths = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
        one = F.struct(F.lit(k).alias("k"), lengths.alias("parts"), every.alias("hits"), F.transform(every, _fix(rule)).alias("fixes"))
        groups.setdefault(rule.script, []).append(F.when(text.rlike(rule.pattern), one))
    # Rules that need the same letters are behind one look for them.
    none = F.array().cast(kind)
    some = [F.array_compact(F.array(*own)) for own in groups.values()]
    return F.concat(*[x if script is None else F.when(text.rlike(script), x).otherwise(none) for script, x in zip(groups, some, strict=True)])


def _findings(rows: DataFrame, keep: list[str], rules: list[Rule]) -> DataFrame:
    """Rows with ``_m`` (see :func:`_hits`) as findings, one row each; of ``_quotes``, where it is, rules that look outside of quotes leave out what begins in one."""
    starts = _all_places()(F.col("_m.parts"), F.transform("_m.hits", lambda h: F.transform(h, lambda x: F.length(x))))
    of = lambda values: lambda k: F.get(F.array(*[F.lit(v) for v in values]), k)
    rank, name, outside = of([LEVELS[r.level] for r in rules]), of([r.name for r in rules]), of([r.outside_quotes for r in rules])
    one = lambda m: lambda h, a: F.struct(a.alias("start"), (a + F.length(h["hits"])).cast("int").alias("end"), rank(m["k"]).alias("rank"), name(m["k"]).alias("rule"), h["fixes"].alias("fix"))
    found = F.zip_with("_m", "_at", lambda m, at: F.zip_with(F.arrays_zip(m["hits"].alias("hits"), m["fixes"].alias("fixes")), at, one(m)))
    if "_quotes" in rows.columns:
        free = lambda f: ~F.exists("_quotes", lambda q: (q["start"] <= f["start"]) & (f["start"] < q["end"]))
        found = F.zip_with("_m", found, lambda m, x: F.when(outside(m["k"]), F.filter(x, free)).otherwise(x))
    return rows.withColumn("_at", starts).select(*keep, F.explode(F.flatten(found)).alias("_f")).select(*keep, "_f.*")


def pattern_findings(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """One row a match: the columns of ``df`` without the text, then start, end, rank, rule and fix. One pass over the rows for all rules."""
    keep = [c for c in df.columns if c != text]
    return _findings(computed(df, _m=_hits(F.col(text), rules)).where("size(_m) > 0"), keep, rules)


def _bare(pattern: str) -> str:
    """The pattern without what looks at the text around the match."""
    out, at, depth, inside = [], 0, 0, False
    while at < len(pattern):
        size = 2 if pattern[at] == "\\" else 1
        piece = pattern[at : at + size]
        if not depth and not inside and pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), at):
            depth, at = 1, at + 1
            continue
        if depth:
            inside = piece == "[" or (inside and piece != "]")
            depth += 0 if inside else (piece == "(") - (piece == ")")
        else:
            out.append(piece)
        at += size
    return "".join(out)


def double_words(words: Column) -> Column:
    """Number of words (two letters or more) that repeat the one before, ignoring case."""
    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - 2)), lambda i: (F.lower(F.get(words, i)) == F.lower(F.get(words, i + 1))) & (F.length(F.get(words, i)) >= 2)))


def guarded_findings(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """Findings of a pack, without any in a bibliography entry, nor those in quotes of rules that look outside them only."""
    keep = [c for c in df.columns if c != text]
    rows = computed(df, _m=_hits(F.col(text), rules)).where((F.size("_m") > 0) & ~C.bibliography(F.col(text)))
    if any(rule.outside_quotes for rule in rules):
        rows = rows.withColumn("_quotes", pattern_spans(F.col(text), Rule("QUOTED", "check", C.QUOTED, None)))
    return _findings(rows, keep, rules)


def hard_sign(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words that end in the hard sign where the lexicon has the soft one, with ``fix``."""
    rows = words.where(F.col("word").rlike("(?iu)[а-яё]ъ$")).withColumn("fix", F.concat(F.expr("left(word, length(word) - 1)"), F.lit("ь")))
    known = lexicon.select(F.col("form").alias("_f")).distinct()
    return rows.join(known, F.lower("fix") == known["_f"], "left_semi")


def double_n(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Short participles written with a double н, with ``fix``: the single form is one, the double form neither that nor an adverb."""
    rows = words.where(F.col("word").rlike("(?iu)нн[аоы]$")).withColumn("fix", F.regexp_replace("word", "(?iu)(н)н([аоы])$", "$1$2"))
    short = lexicon.where("pos = 'PRTS'").select(F.col("form").alias("_f")).distinct()
    other = lexicon.where("pos in ('PRTS', 'ADVB')").select(F.col("form").alias("_g")).distinct()
    return rows.join(short, F.lower("fix") == short["_f"], "left_semi").join(other, F.lower("word") == other["_g"], "left_anti")


def latin_hyphen(words: DataFrame, lexicon: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """A Latin word (or веб, интернет) before a noun whose lemma is among ``heads`` (lemma): ``fix`` puts a hyphen between."""
    following = F.lead("word").over(Window.partitionBy(*keys).orderBy("word_no"))
    rows = words.withColumn("next", following).where(F.col("word").rlike("(?iu)^(?:[a-z]+|веб|интернет)$") & F.col("next").rlike("(?iu)^[а-яё]+$"))
    nouns = lexicon.where("pos = 'NOUN'").join(heads.select("lemma").distinct(), "lemma", "left_semi").select(F.col("form").alias("_f")).distinct()
    return rows.join(nouns, F.lower("next") == nouns["_f"], "left_semi").withColumn("fix", F.concat("word", F.lit("-"), "next"))


def mixed_script(word: Column) -> Column:
    """A word with Latin and Cyrillic letters, made Cyrillic by look-alikes; null for any other."""
    mixed = word.rlike("[A-Za-z]") & word.rlike("[А-Яа-яЁё]")
    return F.when(mixed, F.translate(word, LATIN_LIKE, CYRILLIC_LIKE))


def capital_mid(words: DataFrame, least: int = 2) -> DataFrame:
    """Capitalised words inside a sentence that the same document writes in lower case at least ``least`` times."""
    low = words.where(F.col("word") == F.lower("word")).groupBy("doc_id", F.col("word").alias("low")).agg(F.count(F.lit(1)).alias("n_low")).where(F.col("n_low") >= least)
    mid = words.where((F.col("word_no") > 0) & F.col("word").rlike(r"^\p{Lu}\p{Ll}+$"))
    return mid.withColumn("low", F.lower("word")).join(low, ["doc_id", "low"])


def threshold_findings(predictions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predictions (label, p, ...) that reach their label's error or check threshold, with ``level``."""
    level = F.when(F.col("p") >= F.col("error_at"), "error").when(F.col("p") >= F.col("check_at"), "check")
    return predictions.join(thresholds, "label").withColumn("level", level).where("level is not null").drop("error_at", "check_at")


def quotes_around(text: Column) -> Column:
    """Quoted passages of a text."""
    return F.regexp_extract_all(text, F.lit(r"«[^«»]*»|\"[^\"]*\""), 0)


def protected_words(words: DataFrame) -> DataFrame:
    return words.where(T.protected(F.col("word")))
