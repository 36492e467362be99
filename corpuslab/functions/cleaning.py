"""Cleaning and genre predicates of corpus building, and small text functions of the checker, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T

#: Beginnings of titles of legal acts and of administrative papers, and of those that need a date or number.
ACTS = "Федеральный закон|Федеральный конституционный закон|Закон Российской Федерации|Закон РФ|Постановление|Указ Президента|Распоряжение|Приказ|Кодекс|Гражданский кодекс|Трудовой кодекс|Налоговый кодекс|Уголовный кодекс|Конституция Российской Федерации|Положение|Определение Конституционного Суда|Решение"
ADMIN = "Методика|Методические рекомендации|Методические указания|Инструкция|Регламент|Административный регламент|Порядок|Требования|Письмо|Перечень|Правила|Рекомендации|Типовое положение|Концепция|Стратегия|Доктрина|Программа|Информационное письмо|Разъяснение|Обзор|Доклад"
PERSONAL = "Письмо|Доклад|Обзор|Разъяснение|Информационное письмо"
#: Letters that only the old orthography has, and marks of a bibliography entry.
OLD_LETTERS = r"(?iU)[ѣіѳѵ]|ъ\b"
BIBLIOGRAPHY = r"\[(?:Электронный ресурс|Текст)\]|//|\s/\s[А-ЯЁA-Z]|[–—]\s*С\.\s*\d|\bURL:|\bISBN\b|–\s*\d+\s*с\."
REDIRECTS = ["#перенаправление", "#redirect"]
QUOTED = r"«[^»]*»|\"[^\"]*\"|“[^”]*”"


def titled(title: Column, names: str) -> Column:
    """A title that begins with one of the names, whatever its case."""
    return title.rlike(rf"(?iu)^(?:{names})")


def personal_title_ok(title: Column) -> Column:
    """No author in brackets; a personal genre only with a number or a date."""
    dated = title.rlike(r"№|(?<![\p{L}\d])от \d{1,2}\.\d{2}\.\d{2,4}|\b(?:19[6-9]\d|20\d\d)\b")
    return ~title.rlike(r"\([^)]*\)") & (~titled(title, PERSONAL) | dated)


def is_redirect(text: Column) -> Column:
    head = F.lower(F.ltrim(text))
    return head.startswith(REDIRECTS[0]) | head.startswith(REDIRECTS[1])


def old_orthography(text: Column, first: int | None = None) -> Column:
    """Letters of the old orthography, in the whole text or in its ``first`` characters."""
    return (text if first is None else F.substring(text, 1, first)).rlike(OLD_LETTERS)


def bibliography(text: Column) -> Column:
    return text.rlike(BIBLIOGRAPHY)


def wiki_lines(text: Column) -> Column:
    """Lines of a page without references, tables, templates, markup and list marks."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(ref|table|math|references|sup|sub)\b[^>]*?/>", "")
    out = F.regexp_replace(out, r"(?is)<(?:ref|table|math|references|sup|sub)\b[^>]*>.*?</(?:ref|table|math|references|sup|sub)>", "")
    out = F.regexp_replace(out, r"(?s)\{\|.*?\|\}", "")
    for _ in range(3):  # templates within templates
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[https?://\S+ ([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"'{2,}|={2,}|<[^>]*>", "")
    lines = F.transform(F.split(out, r"\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\s*#:;]+", ""), r"\s+", " ")))
    return F.filter(lines, lambda x: x != "")


def without_unsafe(html: Column, rounds: int = 3) -> Column:
    """Scripts, styles and images removed, again where a removal makes a new one."""
    for _ in range(rounds):
        html = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<(?:img|script|style)\b[^>]*>", "")
    return html


def marker_and_body(text: Column) -> tuple[Column, Column]:
    """The list marker at the beginning, which no model is shown, and the rest."""
    marker = T.list_marker(text)
    return marker, F.substr(text, F.length(marker) + 1)


def common_prefix(x: Column, y: Column) -> Column:
    """Characters that two strings share at their beginning."""
    most = F.least(F.length(x), F.length(y))
    return F.size(F.filter(F.sequence(F.lit(0), most), lambda k: (k > 0) & (F.left(x, k) == F.left(y, k))))


def trimmed(before: Column, after: Column) -> Column:
    """(skip, before, after) of an edit without the characters that both sides share at their ends."""
    a = common_prefix(before, after)
    x, y = F.substr(before, a + 1), F.substr(after, a + 1)
    b = common_prefix(F.reverse(x), F.reverse(y))
    return F.struct(a.alias("skip"), F.left(x, F.length(x) - b).alias("before"), F.left(y, F.length(y) - b).alias("after"))


def utf16_length(text: Column) -> Column:
    """Length in units of 16 bits: characters beyond the basic plane take two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def gaps(text: Column) -> Column:
    """What stands between each word and the next."""
    parts = F.split(text, T.WORD, -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))


def with_comma(gap: Column, want: Column) -> Column:
    """A gap with the comma set or removed."""
    has = gap.startswith(",")
    return F.when(want & ~has, F.concat(F.lit(","), gap)).when(~want & has, F.substr(gap, F.lit(2))).otherwise(gap)


def compound_known(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct hyphenated words (word) all of whose parts are in the lexicon."""
    parts = words.where(F.col("word").contains("-")).select("word", F.explode(F.filter(F.split("word", "-"), lambda p: p != "")).alias("part")).distinct()
    known = lexicon.select(F.col("word").alias("part")).distinct().withColumn("_k", F.lit(1))
    return parts.join(known, "part", "left").groupBy("word").agg(F.min(F.coalesce("_k", F.lit(0))).alias("_all")).where("_all = 1").select("word")


def damaged(words: DataFrame, lexicon: DataFrame, vowels: str = "оеи", least: int = 5, rest: int = 3) -> DataFrame:
    """Distinct words (word) that extraction has damaged: a hyphen of a line's end left inside a known word, or two known
    words run together at a joining vowel."""
    known = lexicon.select(F.col("word").alias("part")).distinct()
    inside = words.select("word").distinct().where(F.col("word").contains("-")).withColumn("part", F.replace("word", F.lit("-"), F.lit(""))).join(known, "part", "left_semi").select("word")
    cut = words.select("word").distinct().where(F.length("word") >= least + rest + 1).select("word", F.explode(F.sequence(F.lit(least), F.length("word") - rest - 1)).alias("at"))
    cut = cut.select("word", F.expr("substring(word, 1, at)").alias("part"), F.expr("substring(word, at + 1)").alias("tail")).where(F.right("part", F.lit(1)).isin(*vowels))
    run = cut.join(known, "part", "left_semi").drop("part").withColumnRenamed("tail", "part").join(known, "part", "left_semi").select("word").distinct()
    return inside.union(run).distinct()


def prefix_split(words: DataFrame, prefixes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, prefix, rest): words made of a listed prefix and a known rest, the longest prefix of each; an equi-join on
    the beginnings of each length that a prefix has."""
    sizes = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())  # a listed prefix is a few letters
    if not sizes:
        return words.select("word", F.lit("").alias("prefix"), F.lit("").alias("rest")).limit(0)
    heads = words.select("word").distinct().withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).where("length(word) > n")
    heads = heads.select("word", F.expr("left(word, n)").alias("prefix"), F.expr("substring(word, n + 1)").alias("rest"))
    found = heads.join(prefixes.select("prefix").distinct(), "prefix").join(lexicon.select(F.col("word").alias("rest")).distinct(), "rest", "left_semi")
    return found.groupBy("word").agg(F.max_by(F.struct("prefix", "rest"), F.length("prefix")).alias("b")).select("word", "b.prefix", "b.rest")


def sub_tokens(words: Column, size: int) -> Column:
    """Sub-tokens of an array of words: pieces of ``size`` letters, as (word_no, start, piece)."""
    numbered = F.transform(words, lambda w, i: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / size).cast("int")), lambda k: F.struct(i.alias("word_no"), (k * size).alias("start"), F.substring(w, k * size + 1, F.lit(size)).alias("piece"))))
    return F.flatten(numbered)


def label_places(words: Column, size: int) -> Column:
    """For each word the number of its first sub-token, which carries the label; the others are ignored."""
    return F.transform(F.filter(F.transform(sub_tokens(words, size), lambda t, i: F.struct(t["start"].alias("start"), i.alias("place"))), lambda t: t["start"] == 0), lambda t: t["place"])


def padded(values: Column, size: Column, filler: Column) -> Column:
    """An array cut or filled up to a size."""
    return F.concat(F.slice(values, F.lit(1), size), F.array_repeat(filler, F.greatest(size - F.size(values), F.lit(0))))


def errors_per_batch(batch: Column, share: Column) -> Column:
    """How many rows of a batch are errors: the share, but one at least and one less than all."""
    return F.least(batch - 1, F.greatest(F.lit(1), F.round(batch * share))).cast("int")
