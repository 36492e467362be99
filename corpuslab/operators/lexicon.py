"""Vocabulary, document frequency, and the fuzzy and split-point joins over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary(words: DataFrame, least: int = 1) -> DataFrame:
    """(word, n) of lower-cased words with at least ``least`` occurrences."""
    return words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def document_frequency(words: DataFrame, doc: str = "doc_id", least: int = 1) -> DataFrame:
    """(word, n_docs, n): pairs of word and document are summed first, so no set of documents is held a word."""
    pairs = words.groupBy(F.lower("word").alias("word"), doc).agg(F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("k").alias("n")).where(F.col("n_docs") >= least)


def capital_share(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n, n_capital, share) of words by how often they begin with a capital."""
    capital = F.substring("word", 1, 1).rlike(r"\p{Lu}")
    out = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count_if(capital).alias("n_capital"))
    return out.where(F.col("n") >= least).withColumn("share", F.round(F.col("n_capital") / F.col("n"), 6))


def split_glued(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(word, left, right): two known words that make up an unknown one, the best by its rarer half."""
    cut = unknown.where(F.length("word") >= 4).select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("at"))
    cut = cut.select("word", F.expr("substring(word, 1, at)").alias("left"), F.expr("substring(word, at + 1)").alias("right"))
    halves = cut.join(known.select(F.col("word").alias("left"), F.col("n").alias("n_left")), "left").join(known.select(F.col("word").alias("right"), F.col("n").alias("n_right")), "right")
    best = F.max_by(F.struct("left", "right"), F.struct(F.least("n_left", "n_right"), F.length("left"), "left"))
    return halves.groupBy("word").agg(best.alias("b")).select("word", "b.left", "b.right")


def _deletions(df: DataFrame, name: str) -> DataFrame:
    """Every word with all strings that one deletion makes of it, and itself."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(F.col(name), F.lit(1), i - 1), F.substring(F.col(name), i + 1, F.length(name))))
    return df.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(name), cut))))


def one_edit_pairs(rare: DataFrame, frequent: DataFrame) -> DataFrame:
    """(word, suggestion, n): frequent words one edit from a rare one, with the same first letter.

    Two words within one edit share a deletion, so an equi-join on deletions finds all; the distance is then checked."""
    a = _deletions(rare.select("word"), "word")
    b = _deletions(frequent.select(F.col("word").alias("suggestion"), "n"), "suggestion")
    near = a.join(b, "key").select("word", "suggestion", "n").distinct()
    return near.where((F.col("word") != F.col("suggestion")) & (F.left("word", F.lit(1)) == F.left("suggestion", F.lit(1))) & (F.levenshtein("word", "suggestion") <= 1))


def suggest(rare: DataFrame, frequent: DataFrame) -> DataFrame:
    """(word, suggestion, n): the most frequent neighbour, ties by the word."""
    best = F.min_by(F.struct("suggestion", "n"), F.struct(-F.col("n"), "suggestion"))
    return one_edit_pairs(rare, frequent).groupBy("word").agg(best.alias("b")).select("word", "b.suggestion", "b.n")


def dehyphenated(lines: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, line_no, line) with the halves of words cut at a line's end put together where the whole is known, and
    with the hyphen kept where it is not; the second half leaves its line."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("line_no")
    head, tail = F.regexp_extract("line", r"(\p{L}+)-$", 1), F.regexp_extract(F.lead("line").over(w), r"^(\p{Ll}+)", 1)
    rows = lines.withColumns({"_head": head, "_tail": tail}).withColumn("_cut", (F.col("_head") != "") & (F.coalesce("_tail", F.lit("")) != ""))
    known = lexicon.select(F.col("word").alias("_word")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, F.lower(F.concat("_head", "_tail")) == F.col("_word"), "left")
    whole = F.concat(F.regexp_replace("line", r"-$", F.lit("")), F.when(F.col("_known"), "").otherwise("-"), F.col("_tail"))
    rows = rows.withColumn("line", F.when(F.col("_cut"), whole).otherwise(F.col("line"))).withColumn("_lost", F.lag(F.when(F.col("_cut"), F.length("_tail"))).over(w))
    return rows.withColumn("line", F.when(F.col("_lost").isNotNull(), F.ltrim(F.expr("substring(line, _lost + 1)"))).otherwise(F.col("line"))).select(*lines.columns)
