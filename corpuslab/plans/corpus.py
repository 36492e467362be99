"""Corpus queries: segmentation, filters, deduplication, splits, samples, vocabulary, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions import hashing as H
from corpuslab.functions import segment as S
from corpuslab.functions import text as T
from corpuslab.operators import dedup, filters, lexicon, profile, sampling
from corpuslab.plans.registry import SQL_SENTENCES, SQL_WORDS, query, sql_count, sql_key, sql_uniform
from corpuslab.sources import readers


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return readers.table(spark, d, "documents").select(*(columns or ("doc_id", "lang", "source", "text")))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return S.sentences(documents(spark, d))


def words(spark: SparkSession, d: str) -> DataFrame:
    return S.word_rows(documents(spark, d))


_CHECKABLE = rf"""len(string_split(trim(sentence), ' ')) BETWEEN 5 AND 60
  AND {sql_count("sentence", r"\pL")} >= 0.6 * length(replace(sentence, ' ', '')) AND length(replace(sentence, ' ', '')) > 0
  AND {sql_count("sentence", "[0-9]")} <= 0.15 * length(replace(sentence, ' ', ''))
  AND NOT (contains(sentence, chr(9)) OR contains(sentence, '....') OR contains(sentence, '|') OR contains(sentence, '='))
  AND right(sentence, 1) IN ('.', '!', '?', '…', ':', ';')"""
_BUCKET = "CASE WHEN n < 8 THEN '<8' WHEN n <= 15 THEN '8-15' WHEN n <= 25 THEN '16-25' WHEN n <= 40 THEN '26-40' ELSE '>40' END"
_N_WORDS = sql_count("sentence", r"[\pL\pN]+(?:[-‑][\pL\pN]+)*")


@query(f"WITH {SQL_WORDS} SELECT lower(word) AS word, count(*) AS n FROM words GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, 1")
def vocab_min_count(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.vocabulary(words(spark, d), 5).orderBy(F.desc("n"), "word")


@query(f"WITH {SQL_SENTENCES} SELECT doc_id, para_no, sent_no, sentence FROM sentences")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark, d).select("doc_id", F.col("para_no").cast("long"), F.col("sent_no").cast("long"), "sentence")


@query(f"WITH {SQL_SENTENCES} SELECT doc_id, para_no, sent_no, len(string_split(trim(sentence), ' ')) AS n_words FROM sentences WHERE {_CHECKABLE}")
def checkable_sentences(spark: SparkSession, d: str) -> DataFrame:
    out = sentences(spark, d).where(filters.checkable(F.col("sentence")))
    return out.select("doc_id", F.col("para_no").cast("long"), F.col("sent_no").cast("long"), F.size(F.split(F.trim("sentence"), " ")).cast("long").alias("n_words"))


_COUNT = lambda piece: f"(length(sentence) - length(replace(sentence, '{piece}', '')))"
_BALANCED = f"""({_COUNT('"')} % 2 = 0 AND {_COUNT('«')} = {_COUNT('»')} AND {_COUNT('(')} = {_COUNT(')')} AND {_COUNT('[')} = {_COUNT(']')})"""


@query(rf"""WITH {SQL_SENTENCES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {sql_key("sentence")} ORDER BY doc_id, para_no, sent_no) > 1 AS again, {_N_WORDS} AS n FROM sentences),
reasons AS (SELECT lang, CASE WHEN n < 5 OR length(sentence) < 25 THEN 'short' WHEN n > 60 OR length(sentence) > 400 THEN 'long'
  WHEN {sql_count("sentence", r"\pL")} < 0.8 * length(replace(sentence, ' ', '')) OR length(replace(sentence, ' ', '')) = 0 THEN 'letters'
  WHEN contains(sentence, '|') OR contains(sentence, '=') THEN 'mark' WHEN NOT {_BALANCED} THEN 'unbalanced' WHEN again THEN 'duplicate' ELSE 'kept' END AS reason FROM ranked)
SELECT lang, reason, count(*) AS n FROM reasons GROUP BY ALL""")
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences are counted by key and reason before they move; of each key the group with the first place keeps one."""
    key = F.unhex(F.md5(T.match_key(F.col("sentence")))).alias("key")
    rows = sentences(spark, d).select(key, "lang", filters.drop_reason(F.col("sentence")).alias("reason"), F.struct("doc_id", "para_no", "sent_no").alias("place"))
    groups = rows.groupBy("key", "lang", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    kept = (F.col("place") == F.min("place").over(Window.partitionBy("key"))).cast("long")
    whole = F.array(F.struct("reason", "n"))
    cut = F.array(F.struct(F.lit("kept").alias("reason"), kept.alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - kept).alias("n")))
    parts = groups.select("lang", F.when(F.col("reason") == "kept", cut).otherwise(whole).alias("parts")).select("lang", F.inline("parts"))
    return parts.where("n > 0").groupBy("lang", "reason").agg(F.sum("n").alias("n"))


@query(rf"""SELECT lang, source, count(*) AS n_docs, sum(length(text)) AS chars, round(avg(length(text)), 4) AS mean_chars,
 sum({sql_count("text", "[0-9]+")}) AS digit_runs, count(*) FILTER (WHERE contains(text, '|')) AS with_bars, max(len(string_split_regex(text, '\n+'))) AS most_pars
 FROM documents GROUP BY ROLLUP (lang, source)""")
def lang_source_shape_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).rollup("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length(t)).alias("chars"), F.round(F.avg(F.length(t)), 4).alias("mean_chars"), F.sum(F.size(T.digit_runs(t))).alias("digit_runs"),
        F.count_if(t.contains("|")).alias("with_bars"), F.max(F.size(F.split(t, r"\n+"))).cast("long").alias("most_pars"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "doc_id", "text").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(f"SELECT md5({sql_key('text')}) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {sql_key('text')} HAVING count(*) > 1")
def key_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(documents(spark, d, "doc_id", "text"), F.md5(T.match_key(F.col("text"))), "doc_id")


@query(f"""SELECT doc_id, quality FROM (SELECT d.doc_id, coalesce(l.quality, -1) AS quality,
 row_number() OVER (PARTITION BY {sql_key('text')} ORDER BY coalesce(l.quality, -1) DESC, d.doc_id) AS r FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE r = 1""")
def prioritised_dedup_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "doc_id", "text").select("doc_id", F.sha2(T.match_key(F.col("text")), 256).alias("key"))
    labels = readers.table(spark, d, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))
    return dedup.first_wins(rows, F.col("key"), -F.col("quality"), F.col("doc_id")).select("doc_id", "quality")


_BENCH = r"""bench AS (SELECT DISTINCT key FROM (SELECT """ + sql_key("s") + r""" AS key FROM (SELECT unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
 '([.!?…;:])\s+([«"(]?[\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM benchmark)) WHERE length(key) >= 20)"""


def benchmark_keys(spark: SparkSession, d: str) -> DataFrame:
    items = readers.table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return S.sentences(items).select(T.match_key(F.col("sentence")).alias("key")).where("length(key) >= 20").distinct()


@query(f"WITH {SQL_SENTENCES}, {_BENCH} SELECT DISTINCT doc_id FROM sentences WHERE {sql_key('sentence')} IN (SELECT key FROM bench)")
def benchmark_overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    return dedup.overlapping(sentences(spark, d), T.match_key(F.col("sentence")), benchmark_keys(spark, d), F.col("key")).select("doc_id").distinct()


@query(f"WITH {SQL_SENTENCES}, {_BENCH} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sentences WHERE {sql_key('sentence')} IN (SELECT key FROM bench))")
def benchmark_decontaminate_anti(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "doc_id", "lang").join(benchmark_overlap_semi(spark, d), "doc_id", "left_anti")


@query(f"""WITH {SQL_SENTENCES}, {_BENCH} SELECT lang, count(*) AS n FROM sentences
 WHERE length({sql_key('sentence')}) >= 30 AND {sql_key('sentence')}[1:30] IN (SELECT key[1:30] FROM bench WHERE length(key) >= 30) GROUP BY lang""")
def prefix30_leak_guard(spark: SparkSession, d: str) -> DataFrame:
    known = benchmark_keys(spark, d).where("length(key) >= 30").select(F.substring("key", 1, 30).alias("key"))
    rows = dedup.overlapping(sentences(spark, d), dedup.prefix_guard(F.col("sentence")), known, F.col("key"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_SENTENCES}, {_BENCH}, rows AS (SELECT doc_id, para_no, sent_no, {sql_key('sentence')} AS key FROM sentences WHERE length({sql_key('sentence')}) >= 20)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN key IN (SELECT key FROM bench) THEN 'benchmark'
 WHEN row_number() OVER (PARTITION BY key ORDER BY doc_id, para_no, sent_no) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM rows) GROUP BY reason""")
def anti_join_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences(spark, d).withColumn("key", T.match_key(F.col("sentence"))).where("length(key) >= 20")
    out = dedup.cascade(rows, F.col("key"), [("benchmark", benchmark_keys(spark, d))], F.col("doc_id"), F.col("para_no"), F.col("sent_no"))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, bucket, CASE WHEN bucket < 10 THEN 'dev' WHEN bucket < 20 THEN 'test' ELSE 'train' END AS split
 FROM (SELECT doc_id, CAST((('0x' || md5('doc' || doc_id))::UHUGEINT % 100) AS INTEGER) AS bucket FROM documents)""")
def md5_bucket_split(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return documents(spark, d, "doc_id").select("doc_id", H.md5_bucket(key).alias("bucket"), dedup.split_name(key).alias("split"))


@query("""SELECT doc_id, source, CAST(rank AS INTEGER) AS rank, CAST(copy AS INTEGER) AS copy FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 'cap', doc_id))) AS rank
 FROM documents), (SELECT unnest([1, 2]) AS copy) WHERE rank <= 20""")
def per_source_cap_repeat(spark: SparkSession, d: str) -> DataFrame:
    return sampling.capped(documents(spark, d, "doc_id", "source"), "source", 20, "cap", "doc_id", repeat=2)


@query(f"""WITH sized AS (SELECT doc_id, lang, {sql_count('text', '[^ ]+')} AS n FROM documents), bucketed AS (SELECT doc_id, lang, CASE WHEN n < 100 THEN 'short' WHEN n < 1000 THEN 'medium' ELSE 'long' END AS size FROM sized)
SELECT doc_id, lang, size FROM (SELECT *, count(*) OVER (PARTITION BY lang, size) AS k, row_number() OVER (PARTITION BY lang, size ORDER BY md5(concat_ws('|', 'len', doc_id))) AS r FROM bucketed) WHERE r <= round(k * 0.1)""")
def stratified_length_sample(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("text", F.lit("[^ ]+"))
    rows = documents(spark, d, "doc_id", "lang", "text").select("doc_id", "lang", F.when(n < 100, "short").when(n < 1000, "medium").otherwise("long").alias("size"))
    return sampling.share_of_stratum(rows, ["lang", "size"], 0.1, "len", "doc_id").select("doc_id", "lang", "size")


@query("""SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', 'clean', doc_id))) AS r FROM labels)
 WHERE quality = 0 OR r <= floor(0.1 * (SELECT count(*) FROM labels WHERE quality = 0))""")
def clean_share_cap(spark: SparkSession, d: str) -> DataFrame:
    labels = readers.table(spark, d, "labels").select("doc_id", "quality")
    bad = labels.where("quality = 0").count()
    clean = sampling.capped(labels.where("quality = 1"), "quality", int(0.1 * bad), "clean", "doc_id").select("doc_id", "quality")
    return labels.where("quality = 0").union(clean)


@query(f"""SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ln({sql_uniform("'weighted'", 'doc_id')}) / length(text) DESC, doc_id) AS rank FROM documents) WHERE rank <= 5""")
def weighted_order_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "doc_id", "source", "text").select("doc_id", "source", F.length("text").alias("size"))
    return sampling.weighted_order(rows, F.col("size"), "weighted", "doc_id", "source", 5).select("doc_id", "source", "rank")


@query("""SELECT doc_id, source, CAST(floor((r - 1) / 25) AS INTEGER) AS batch FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 'review', doc_id))) AS r FROM documents)""")
def review_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batches(documents(spark, d, "doc_id", "source"), 25, "review", "doc_id", "source")


@query("SELECT fold, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, CAST((dense_rank() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents) GROUP BY fold")
def fold_by_document(spark: SparkSession, d: str) -> DataFrame:
    ranked = sampling.ordered_rank(documents(spark, d, "doc_id", "lang"), ["lang"], "doc_id")
    return ranked.withColumn("fold", ((F.col("rank") - 1) % 5).cast("int")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH {SQL_WORDS} SELECT lower(word) AS word, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM words GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""")
def doc_frequency_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.document_frequency(words(spark, d), least=5)


@query(rf"""WITH {SQL_WORDS} SELECT lower(word) AS word, count(*) AS n, count(*) FILTER (WHERE regexp_matches(word[1], '\p{{Lu}}')) AS n_capital,
 round(count(*) FILTER (WHERE regexp_matches(word[1], '\p{{Lu}}')) / count(*), 6) AS share FROM words GROUP BY 1 HAVING count(*) >= 5""")
def capital_share(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.capital_share(words(spark, d), 5)


_VOCAB = rf"WITH {SQL_WORDS}, vocab AS (SELECT lower(word) AS word, count(*) AS n FROM words WHERE regexp_full_match(word, '\pL+') GROUP BY 1)"
#: The distance in letters: that of SQL counts bytes, so letters of two bytes are written as one.
_APART = lambda a, b: f"levenshtein({_letters(a)}, {_letters(b)})"
_letters = lambda x: f"translate({x}, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ', '0123456789!#$%&()*+,-./:;<=>?@[]^_~')"


def letter_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.vocabulary(words(spark, d).where(F.col("word").rlike(r"^\p{L}+$")))


@query(f"""{_VOCAB}, cuts AS (SELECT word, unnest(range(2, length(word) - 1)) AS at FROM vocab WHERE n = 1 AND length(word) >= 4),
halves AS (SELECT c.word, c.word[1:c.at] AS l, c.word[c.at + 1:] AS r, least(a.n, b.n) AS k FROM cuts c JOIN vocab a ON a.word = c.word[1:c.at] AND a.n >= 20 JOIN vocab b ON b.word = c.word[c.at + 1:] AND b.n >= 20)
SELECT word, l AS left, r AS right FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY k DESC, length(l) DESC, l DESC) AS o FROM halves) WHERE o = 1""")
def glued_words_split(spark: SparkSession, d: str) -> DataFrame:
    vocab = letter_vocabulary(spark, d)
    return lexicon.split_glued(vocab.where("n = 1"), vocab.where("n >= 20"))


@query(f"""{_VOCAB}, near AS (SELECT a.word, b.word AS suggestion, b.n FROM vocab a JOIN vocab b ON a.word[1] = b.word[1] AND abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word
 WHERE a.n <= 2 AND length(a.word) >= 5 AND b.n >= 20 AND {_APART('a.word', 'b.word')} = 1)
SELECT word, suggestion, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, suggestion) AS o FROM near) WHERE o = 1""")
def typo_suggest(spark: SparkSession, d: str) -> DataFrame:
    vocab = letter_vocabulary(spark, d)
    return lexicon.suggest(vocab.where("n <= 2 and length(word) >= 5"), vocab.where("n >= 20"))


@query(f"""{_VOCAB} SELECT a.word, b.word AS suggestion, b.n FROM vocab a JOIN vocab b ON a.word[1] = b.word[1] AND a.word <> b.word
 WHERE a.n >= 50 AND b.n >= 50 AND {_APART('a.word', 'b.word')} = 1""")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    vocab = letter_vocabulary(spark, d).where("n >= 50")
    return lexicon.one_edit_pairs(vocab, vocab)


@query(f"""{_VOCAB}, known AS (SELECT word FROM vocab WHERE n >= 3) SELECT doc_id, count(*) AS n_unknown FROM words
 WHERE regexp_full_match(word, '\\pL+') AND lower(word) NOT IN (SELECT word FROM known) GROUP BY doc_id""")
def dictionary_anti_join(spark: SparkSession, d: str) -> DataFrame:
    rows = words(spark, d).where(F.col("word").rlike(r"^\p{L}+$")).withColumn("word", F.lower("word"))
    known = lexicon.vocabulary(rows, 3).select("word")
    return rows.join(known, "word", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unknown"))


@query(f"""WITH {SQL_SENTENCES}, rows AS (SELECT doc_id, lower(w) AS word, para_no, sent_no FROM (SELECT doc_id, para_no, sent_no, unnest(regexp_extract_all(sentence, '[\\pL\\pN]+(?:[-‑][\\pL\\pN]+)*')) AS w FROM sentences)),
known AS (SELECT word FROM rows GROUP BY word HAVING count(*) >= 3) SELECT doc_id, count(*) AS n FROM (SELECT doc_id, para_no, sent_no FROM rows GROUP BY ALL HAVING bool_and(word IN (SELECT word FROM known))) GROUP BY doc_id""")
def all_words_known(spark: SparkSession, d: str) -> DataFrame:
    rows = S.word_rows(sentences(spark, d), "sentence")
    clean = filters.unknown_words(rows, lexicon.vocabulary(rows, 3), ["doc_id", "para_no", "sent_no"])
    return clean.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_SENTENCES} SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_BALANCED}) AS n_balanced FROM sentences GROUP BY lang""")
def quote_balance_filter(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(filters.balanced(F.col("sentence"))).alias("n_balanced"))


@query(f"""WITH {SQL_SENTENCES}, sized AS (SELECT lang, source, {_N_WORDS} AS n FROM sentences), kinds AS (SELECT lang, source, {_BUCKET} AS kind FROM sized)
SELECT source, lang, kind, count(*) AS n FROM kinds GROUP BY GROUPING SETS ((source, kind), (source, lang, kind))""")
def kind_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences(spark, d).select("lang", "source", S.length_bucket(T.word_count(F.col("sentence"))).alias("kind"))
    return rows.groupingSets([["source", "kind"], ["source", "lang", "kind"]], "source", "lang", "kind").agg(F.count(F.lit(1)).alias("n"))


_FEATURES = rf"""long AS (SELECT lang, unnest(['length', 'commas', 'digits', 'quotes', 'brackets', 'closed']) AS feature, unnest([
 {_BUCKET}, CAST(least({_COUNT(',')}, 3) AS VARCHAR), CAST(regexp_matches(sentence, '[0-9]') AS VARCHAR), CAST(regexp_matches(sentence, '[«»"]') AS VARCHAR),
 CAST(regexp_matches(sentence, '[()\[\]]') AS VARCHAR), CAST(regexp_matches(right(sentence, 1), '[.!?…]') AS VARCHAR)]) AS value FROM (SELECT *, {_N_WORDS} AS n FROM sentences))"""


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.long_features(sentences(spark, d), ["lang"], profile.shape_features(F.col("sentence")))


@query(f"""WITH {SQL_SENTENCES}, {_FEATURES} SELECT feature, value, n, round(n / sum(n) OVER (PARTITION BY feature), 6) AS share FROM (SELECT feature, value, count(*) AS n FROM long GROUP BY ALL)""")
def feature_share(spark: SparkSession, d: str) -> DataFrame:
    counts = feature_rows(spark, d).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("feature")), 6))


@query(f"""WITH {SQL_SENTENCES}, {_FEATURES}, own AS (SELECT lang, feature, value, n / sum(n) OVER (PARTITION BY lang, feature) AS p FROM (SELECT lang, feature, value, count(*) AS n FROM long GROUP BY ALL)),
whole AS (SELECT feature, value, n / sum(n) OVER (PARTITION BY feature) AS q FROM (SELECT feature, value, count(*) AS n FROM long GROUP BY ALL)),
grid AS (SELECT lang, feature, value, q FROM whole, (SELECT DISTINCT lang FROM long))
SELECT lang, feature, round(0.5 * sum(abs(coalesce(p, 0) - q)), 6) AS tv FROM grid LEFT JOIN own USING (lang, feature, value) GROUP BY ALL""")
def total_variation_by_lang(spark: SparkSession, d: str) -> DataFrame:
    from corpuslab.operators import scoring

    rows = feature_rows(spark, d)
    own = scoring.shares(rows, ["lang", "feature"], "value")
    whole = scoring.shares(rows, ["feature"], "value")
    grid = whole.join(own.select("lang", "feature").distinct(), "feature")  # every language against the whole
    return scoring.total_variation(own, grid.select("lang", "feature", "value", "share"), ["lang", "feature"])


_HTML = r"""SELECT page_id, list_filter(list_transform(string_split(
 replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|title)\b.*?</(?:script|style|title)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'),
 '</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|br|title|body|head|html)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'gs'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages"""


@query(f"SELECT page_id, i - 1 AS para_no, l[i] AS par FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ({_HTML}))")
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return readers.html_paragraphs(readers.table(spark, d, "pages").select("page_id", "html")).select("page_id", F.col("para_no").cast("long"), "par")


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text, 'ёЁ–—−«»„“”', 'еЕ---\"\"\"\"\"'), '(\p{Lu}\.) (\p{Lu}\.)', '\1\2', 'g'), '\s+', ' ', 'g'))) AS normal FROM documents".replace('\\"', '"'))
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "doc_id", "text").select("doc_id", F.md5(T.normal(F.col("text"))).alias("normal"))


@query()
def exact_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by the exact splitter (abbreviations, initials), with code point offsets in their paragraph."""
    return S.exact_sentences(S.paragraphs(documents(spark, d)), "par")
