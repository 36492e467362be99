"""Queries of cleaning, genres, word damage, gaps and sub-tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import cleaning as C
from corpuslab.functions import segment as S
from corpuslab.functions import text as T
from corpuslab.operators import lexicon
from corpuslab.plans.corpus import _VOCAB, documents, letter_vocabulary, sentences, words
from corpuslab.plans.registry import SQL_SENTENCES, SQL_WORDS, query, sql_count
from corpuslab.sources import readers

_WORD = r"[\pL\pN]+(?:[-‑][\pL\pN]+)*"


@query(SQL_SENTENCES.replace("[.!?…;:]", "[.!?…]").join(["WITH ", " SELECT doc_id, para_no, sent_no, sentence FROM sentences"]))
def strict_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by the splitter that does not cut at colons and semicolons."""
    out = S.sentences(documents(spark, d), gap=S.STRICT_GAP)
    return out.select("doc_id", F.col("para_no").cast("long"), F.col("sent_no").cast("long"), "sentence")


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'), '\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]', '\1', 'g'), '''{2,}|={2,}|<[^>]*>', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^[\s*#:;]+', ''), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM c) SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(10))) AS lines FROM l""")
def wiki_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts cleaned of wiki markup, line by line (tables and templates do not occur here; the tests have them)."""
    rows = documents(spark, d, "doc_id", "text").select("doc_id", C.wiki_lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "\n")).alias("lines"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '<(?:script|style)\b.*?</(?:script|style)\s*>|<(?:img|script|style)\b[^>]*>', '', 'gis'), '<(?:script|style)\b.*?</(?:script|style)\s*>|<(?:img|script|style)\b[^>]*>', '', 'gis')) AS html FROM pages""")
def unsafe_html_stripped(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "pages").select("page_id", F.md5(C.without_unsafe(F.col("html"))).alias("html"))


@query(rf"""WITH {SQL_SENTENCES} SELECT lang, count(*) FILTER (WHERE regexp_matches(sentence, '\[(?:Электронный ресурс|Текст)\]|//|\s/\s[А-ЯЁA-Z]|[–—]\s*С\.\s*\d|\bURL:|\bISBN\b|–\s*\d+\s*с\.')) AS n_bibliography,
 count(*) FILTER (WHERE regexp_matches(sentence, '^(?:the|le|la|der|die|das|el) ', 'i')) AS n_titled, count(*) FILTER (WHERE regexp_matches(sentence, '[ѣіѳѵѢІѲѴ]')) AS n_old FROM sentences GROUP BY lang""")
def genre_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bibliography entries, sentences that begin like a title, and old letters."""
    s = F.col("sentence")
    return sentences(spark, d).groupBy("lang").agg(F.count_if(C.bibliography(s)).alias("n_bibliography"), F.count_if(C.titled(s, "(?:the|le|la|der|die|das|el) ")).alias("n_titled"), F.count_if(C.old_orthography(s)).alias("n_old"))


@query(f"""{_VOCAB}, k AS (SELECT word FROM vocab WHERE n >= 20), c AS (SELECT DISTINCT word, unnest(range(5, length(word) - 3)) AS at FROM vocab WHERE length(word) >= 9)
SELECT DISTINCT c.word FROM c JOIN k a ON a.word = c.word[1:c.at] JOIN k b ON b.word = c.word[c.at + 1:] WHERE c.word[c.at] IN ('o', 'e', 'i', 'a', 'n')""")
def damaged_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that are two known words run together at a joining letter."""
    vocab = letter_vocabulary(spark, d)
    return C.damaged(vocab, vocab.where("n >= 20"), "oeian")


@query(f"""WITH {SQL_WORDS}, vocab AS (SELECT lower(word) AS word, count(*) AS n FROM words GROUP BY 1), k AS (SELECT word FROM vocab WHERE n >= 3),
p AS (SELECT word, unnest(list_filter(string_split(word, '-'), lambda x: x <> '')) AS part FROM vocab WHERE contains(word, '-')) SELECT word FROM p GROUP BY word HAVING bool_and(part IN (SELECT word FROM k))""")
def compound_known_words(spark: SparkSession, d: str) -> DataFrame:
    vocab = lexicon.vocabulary(words(spark, d))
    return C.compound_known(vocab, vocab.where("n >= 3"))


@query(f"""WITH {SQL_WORDS}, v AS (SELECT DISTINCT lang, lower(word) AS word FROM words) SELECT a.word FROM v a JOIN v b USING (word) WHERE a.lang = 'en' AND b.lang = 'fr'""")
def dictionary_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Words that two dictionaries share: one pass, with a flag for each dictionary that combines before the shuffle."""
    rows = words(spark, d).where("lang in ('en', 'fr')").groupBy(F.lower("word").alias("word"))
    return rows.agg(F.bool_or(F.col("lang") == "en").alias("a"), F.bool_or(F.col("lang") == "fr").alias("b")).where("a and b").select("word")


_PREFIXES = ["ba", "be", "con", "de", "in", "re", "un", "ver"]


@query(f"""{_VOCAB}, k AS (SELECT word FROM vocab WHERE n >= 20), f AS (SELECT v.word, p, v.word[length(p) + 1:] AS rest FROM vocab v, (SELECT unnest({_PREFIXES}) AS p) WHERE starts_with(v.word, p) AND length(v.word) > length(p))
SELECT word, p AS prefix, rest FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(p) DESC) AS r FROM f WHERE rest IN (SELECT word FROM k)) WHERE r = 1""")
def prefix_splits(spark: SparkSession, d: str) -> DataFrame:
    """Words made of a listed prefix and a known word."""
    vocab = letter_vocabulary(spark, d)
    return C.prefix_split(vocab, spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string"), vocab.where("n >= 20"))


@query(rf"""WITH g AS (SELECT lang, string_split_regex(text, '{_WORD}') AS parts FROM documents), e AS (SELECT lang, unnest(parts[2:len(parts) - 1]) AS gap FROM g)
SELECT lang, CASE WHEN gap = ' ' THEN 'space' WHEN starts_with(gap, ',') THEN 'comma' WHEN regexp_matches(gap, '\n') THEN 'line' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(length(gap)) AS BIGINT) AS chars FROM e GROUP BY ALL""")
def word_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What stands between neighbouring words."""
    gap = F.col("gap")
    rows = documents(spark, d, "lang", "text").select("lang", F.explode(C.gaps(F.col("text"))).alias("gap"))
    kind = F.when(gap == " ", "space").when(gap.startswith(","), "comma").when(gap.contains("\n"), "line").otherwise("other")
    return rows.groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(gap)).alias("chars"))


@query(rf"""WITH {SQL_SENTENCES}, m AS (SELECT lang, sentence, regexp_extract(sentence, '^(\s*(?:\d+(?:\.\d+)*[.)]|\pL[)]|[-•*])\s+)', 1) AS marker FROM sentences)
SELECT lang, marker <> '' AS marked, count(*) AS n, CAST(sum(length(marker)) AS BIGINT) AS marker_chars, CAST(sum(length(sentence) - length(marker)) AS BIGINT) AS body_chars FROM m GROUP BY ALL""")
def marker_and_body(spark: SparkSession, d: str) -> DataFrame:
    """List markers apart from the text that a model sees."""
    marker, body = C.marker_and_body(F.col("sentence"))
    rows = sentences(spark, d).select("lang", marker.alias("m"), body.alias("b"))
    return rows.groupBy("lang", (F.col("m") != "").alias("marked")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("m")).alias("marker_chars"), F.sum(F.length("b")).alias("body_chars"))


@query(f"""WITH {SQL_WORDS}, p AS (SELECT DISTINCT lower(word) AS x, lower(y) AS y FROM (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY word_no) AS y FROM words) WHERE y IS NOT NULL),
a AS (SELECT x, y, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda k: left(x, k) = left(y, k))) AS k FROM p), b AS (SELECT *, x[k + 1:] AS u, y[k + 1:] AS v FROM a),
c AS (SELECT k, u, v, len(list_filter(range(1, least(length(u), length(v)) + 1), lambda j: right(u, j) = right(v, j))) AS q FROM b)
SELECT k AS skip, length(u) - q AS n_before, length(v) - q AS n_after, count(*) AS n FROM c GROUP BY ALL""")
def trimmed_edits(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of neighbouring words as an edit, cut to what differs."""
    from pyspark.sql import Window

    y = F.lead("word").over(Window.partitionBy("doc_id").orderBy("word_no"))
    pairs = words(spark, d).select(F.lower("word").alias("x"), F.lower(y).alias("y")).where("y is not null").distinct()
    cut = pairs.select(C.trimmed(F.col("x"), F.col("y")).alias("t"))
    return cut.groupBy(F.col("t.skip").cast("long").alias("skip"), F.length("t.before").cast("long").alias("n_before"), F.length("t.after").cast("long").alias("n_after")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT doc_id, length(text) + {sql_count('text', '[' + chr(0x10000) + '-' + chr(0x10FFFF) + ']')} AS units FROM documents""")
def utf16_lengths(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "doc_id", "text").select("doc_id", C.utf16_length(F.col("text")).cast("long").alias("units"))


@query(f"""WITH {SQL_WORDS}, t AS (SELECT doc_id, word_no, CAST(ceil(length(word) / 4.0) AS BIGINT) AS k FROM words), p AS (SELECT doc_id, k, coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM t)
SELECT doc_id, count(*) AS n_words, CAST(sum(k) AS BIGINT) AS n_tokens, CAST(sum(place) AS BIGINT) AS places, sum(k) <= 512 AS fits FROM p GROUP BY doc_id""")
def sub_token_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sub-tokens of every word, the places that carry labels, and whether the document fits the encoder."""
    rows = documents(spark, d, "doc_id", "text").select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(C.sub_tokens(F.col("w"), 4)).cast("long").alias("n_tokens"), C.label_places(F.col("w"), 4).alias("p"))
    return rows.select("doc_id", "n_words", "n_tokens", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"), (F.col("n_tokens") <= 512).alias("fits"))
