"""Queries of findings and token context: rules, spans, merges, differences, corruption, streams of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions import cleaning
from corpuslab.functions import text as T
from corpuslab.operators import diff, review, rules, sampling, spans, synth
from corpuslab.plans.corpus import documents, sentences, words
from corpuslab.plans.registry import SQL_SENTENCES, SQL_WORDS, query, sql_count, sql_key
from corpuslab.sources import readers


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\pL\pN]+(?:[-‑][\pL\pN]+)*') AS w FROM documents)
SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: lower(w[i]) = lower(w[i + 1]) AND length(w[i]) >= 2)) AS n_double FROM w""")
def double_word_rule(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "doc_id", "text").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", rules.double_words(F.col("w")).cast("long").alias("n_double"))


@query(rf"""WITH {SQL_WORDS} SELECT doc_id, word_no, word, regexp_extract(word, '^(\pL+)', 1) || ' ' || regexp_extract(word, '(\d+)$', 1) AS fix FROM words WHERE regexp_full_match(word, '\pL{{3,}}\d+')""")
def glued_digit_rule(spark: SparkSession, d: str) -> DataFrame:
    hits = words(spark, d).where(F.col("word").rlike(r"^\p{L}{3,}\d+$"))
    return hits.select("doc_id", F.col("word_no").cast("long"), "word", F.regexp_replace("word", r"^(\p{L}+)(\d+)$", "$1 $2").alias("fix"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[%$*&#!|]{2,}') AS l FROM documents) SELECT doc_id, len(l) AS n FROM m WHERE len(l) > 0""")
def mark_run_rule(spark: SparkSession, d: str) -> DataFrame:
    found = rules.pattern_findings(documents(spark, d, "doc_id", "text"), "text", [rules.MARK_RUN])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_WORDS} SELECT doc_id, count(*) AS n FROM words WHERE regexp_matches(word, '[0-9]') OR {sql_count("word", chr(92) + "p{Lu}")} >= 2 GROUP BY doc_id""")
def protected_words(spark: SparkSession, d: str) -> DataFrame:
    return rules.protected_words(words(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {SQL_WORDS}, low AS (SELECT doc_id, word FROM words WHERE word = lower(word) GROUP BY ALL HAVING count(*) >= 2)
SELECT w.doc_id, count(*) AS n FROM words w JOIN low l ON w.doc_id = l.doc_id AND lower(w.word) = l.word WHERE w.word_no > 0 AND regexp_full_match(w.word, '\p{{Lu}}\p{{Ll}}+') GROUP BY w.doc_id""")
def capital_mid_rule(spark: SparkSession, d: str) -> DataFrame:
    return rules.capital_mid(words(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT lang, unnest(regexp_extract_all(text, '[\\pL\\pN]+,?')) AS t FROM documents)
SELECT lang, count(*) AS n_gaps, count(*) FILTER (WHERE right(t, 1) = ',') AS n_commas, round(count(*) FILTER (WHERE right(t, 1) = ',') / count(*), 6) AS rate FROM m GROUP BY lang""")
def gap_comma_rates(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+,?"), 0)
    counts = documents(spark, d, "lang", "text").select("lang", F.size(tokens).alias("k"), F.size(F.filter(tokens, lambda t: t.endswith(","))).alias("c"))
    out = counts.groupBy("lang").agg(F.sum("k").alias("n_gaps"), F.sum("c").alias("n_commas"))
    return out.withColumn("rate", F.round(F.col("n_commas") / F.col("n_gaps"), 6))


_GAPS = rf"""{SQL_SENTENCES}, gaps AS (SELECT doc_id, lang, para_no, sent_no, i AS gap_no, l[i] AS token FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i
 FROM (SELECT doc_id, lang, para_no, sent_no, regexp_extract_all(sentence, '[\pL\pN]+,?') AS l FROM sentences)))"""


def gaps(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.regexp_extract_all("sentence", F.lit(r"[\p{L}\p{N}]+,?"), 0)
    return sentences(spark, d).select("doc_id", "lang", "para_no", "sent_no", F.posexplode(tokens).alias("gap_no", "token"))


@query(f"""WITH {_GAPS}, f AS (SELECT lang, right(token, 1) = ',' AS has, coalesce(bool_or(right(token, 1) = ',') OVER (PARTITION BY doc_id, para_no, sent_no ORDER BY gap_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM gaps)
SELECT lang, has, seen, count(*) AS n FROM f GROUP BY ALL""")
def running_comma_flag(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "para_no", "sent_no").orderBy("gap_no").rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("token").endswith(",")
    rows = gaps(spark, d).select("lang", has.alias("has"), F.coalesce(F.max(has).over(w), F.lit(False)).alias("seen"))
    return rows.groupBy("lang", "has", "seen").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_GAPS}, f AS (SELECT lang, CASE WHEN lead(token) OVER w IS NULL THEN 'last' WHEN lead(token, 2) OVER w IS NULL THEN 'second last' ELSE 'inner' END AS place,
 lower(left(lag(token) OVER w, 1)) = lower(left(token, 1)) AS alike FROM gaps WINDOW w AS (PARTITION BY doc_id, para_no, sent_no ORDER BY gap_no))
SELECT lang, place, count(*) AS n, count(*) FILTER (WHERE alike) AS n_alike FROM f GROUP BY ALL""")
def gap_context_features(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "para_no", "sent_no").orderBy("gap_no")
    place = F.when(F.lead("token").over(w).isNull(), "last").when(F.lead("token", 2).over(w).isNull(), "second last").otherwise("inner")
    first = lambda c: F.lower(F.left(c, F.lit(1)))
    rows = gaps(spark, d).select("lang", place.alias("place"), (first(F.lag("token").over(w)) == first(F.col("token"))).alias("alike"))
    return rows.groupBy("lang", "place").agg(F.count(F.lit(1)).alias("n"), F.count_if("alike").alias("n_alike"))


@query(f"""WITH {SQL_WORDS}, p AS (SELECT doc_id, word_no, coalesce(sum(length(word)) OVER (PARTITION BY doc_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM words)
SELECT doc_id, count(*) AS n, CAST(max(start) AS BIGINT) AS last_start, CAST(sum(start) AS BIGINT) AS total FROM p GROUP BY doc_id""")
def token_prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = words(spark, d).select("doc_id", F.coalesce(F.sum(F.length("word")).over(w), F.lit(0)).alias("start"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("last_start"), F.sum("start").alias("total"))


_SPANS = r"""spans AS (SELECT doc_id, start, finish, rule, rank FROM (
 SELECT doc_id, CAST(word_no * 3 AS INTEGER) AS start, CAST(word_no * 3 + length(word) AS INTEGER) AS finish, 'LONG' AS rule, 2 AS rank FROM words WHERE length(word) >= 12
 UNION ALL SELECT doc_id, CAST(word_no * 3 + 2 AS INTEGER), CAST(word_no * 3 + 7 AS INTEGER), 'CAPITAL', 3 FROM words WHERE regexp_matches(word, '^\p{Lu}')
 UNION ALL SELECT doc_id, CAST(word_no * 3 AS INTEGER), CAST(word_no * 3 AS INTEGER), 'SHORT', 1 FROM words WHERE length(word) <= 2))"""


def span_table(spark: SparkSession, d: str) -> DataFrame:
    """Findings of three plain rules over a token grid of three places a word."""
    rows = words(spark, d).select("doc_id", (F.col("word_no") * 3).alias("at"), "word")
    length = F.length("word")
    parts = [
        rows.where(length >= 12).select("doc_id", F.col("at").alias("start"), (F.col("at") + length).alias("end"), F.lit("LONG").alias("rule"), F.lit(2).alias("rank")),
        rows.where(F.col("word").rlike(r"^\p{Lu}")).select("doc_id", (F.col("at") + 2).alias("start"), (F.col("at") + 7).alias("end"), F.lit("CAPITAL").alias("rule"), F.lit(3).alias("rank")),
        rows.where(length <= 2).select("doc_id", F.col("at").alias("start"), F.col("at").alias("end"), F.lit("SHORT").alias("rule"), F.lit(1).alias("rank")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


_OVERLAP = """CASE WHEN a.start = a.finish AND b.start = b.finish THEN a.start = b.start WHEN a.start = a.finish THEN b.start < a.start AND a.start < b.finish
 WHEN b.start = b.finish THEN a.start < b.start AND b.start < a.finish ELSE a.start < b.finish AND b.start < a.finish END"""


@query(f"WITH {SQL_WORDS}, {_SPANS} SELECT a.doc_id, count(*) AS n FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.rule = 'LONG' AND b.rule = 'CAPITAL' AND {_OVERLAP} GROUP BY a.doc_id")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    found = span_table(spark, d)
    joined = spans.overlap_join(found.where("rule = 'LONG'"), found.where("rule = 'CAPITAL'"), ["doc_id"])
    return joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_WORDS}, {_SPANS} SELECT DISTINCT a.doc_id, a.start FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.rule = 'SHORT' AND b.rule = 'LONG' AND a.start <= b.finish AND b.start <= a.finish")
def interval_touch_semi(spark: SparkSession, d: str) -> DataFrame:
    found = span_table(spark, d)
    touched = spans.span_join(found.where("rule = 'SHORT'"), found.where("rule = 'LONG'"), ["doc_id"], "left_semi", closed=True)
    return touched.select("doc_id", "start").distinct()


@query()
def merge_findings(spark: SparkSession, d: str) -> DataFrame:
    """Greedy merge of overlapping findings of a whole document, one row each."""
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("rank").cast("int").alias("rank"), "rule", F.lit(None).cast("string").alias("fix"))
    rows = span_table(spark, d).groupBy("doc_id").agg(F.collect_list(one).alias("found"))
    return spans.merged(rows, "found").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(text, '[%$*&#!|]{2,}', '', 'g') AS fixed FROM documents) SELECT doc_id, md5(fixed) AS fixed FROM m""")
def apply_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a rule, in the row of their document, and applied there."""
    rows = documents(spark, d, "doc_id", "text").withColumn("found", rules.pattern_spans(F.col("text"), rules.MARK_RUN))
    return spans.apply_fixes(rows, "text", "found", "fixed").select("doc_id", F.md5("fixed").alias("fixed"))


@query(f"""WITH {SQL_WORDS}, r AS (SELECT doc_id, word_no * 20 AS start, word_no * 20 + length(word) AS finish, lower(word) || '.' AS fix FROM words WHERE length(word) >= 10)
SELECT doc_id, start, CAST(coalesce(sum(length(fix) - (finish - start)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM r""")
def coordinate_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = words(spark, d).where(F.length("word") >= 10).select("doc_id", (F.col("word_no") * 20).cast("long").alias("start"), (F.col("word_no") * 20 + F.length("word")).alias("end"), F.concat(F.lower("word"), F.lit(".")).alias("fix"))
    return spans.shifted(rows, ["doc_id"]).select("doc_id", "start", "shift")


@query()
def token_diff(spark: SparkSession, d: str) -> DataFrame:
    """Token edits between corrupted sentences and their originals by kind, and how many labels the corruption left."""
    rows = sentences(spark, d).withColumn("key", F.concat_ws(":", "doc_id", "para_no", "sent_no"))
    out = synth.corrupted(rows, "sentence", "key", "seed-1").select("lang", F.col("corrupted.text").alias("src"), F.col("sentence").alias("gold"), "corrupted.comma")
    labels = out.groupBy("lang").agg(F.sum(F.size(F.filter("comma", lambda x: x != "KEEP"))).alias("n_labels"))
    edits = diff.edit_rows(out.where("src <> gold").select("lang", "src", "gold"), "src", "gold")
    return edits.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n")).join(labels, "lang")


@query(f"""WITH k AS (SELECT doc_id, text, {sql_key('text')} AS key FROM documents), f AS (SELECT key, min(doc_id) AS first_id FROM k GROUP BY key)
SELECT k.doc_id, first_id, length(k.text) AS n_src, length(g.text) AS n_gold, k.text = g.text AS clean FROM k JOIN f USING (key) JOIN k g ON g.doc_id = first_id WHERE k.doc_id <> first_id""")
def near_copy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose whole match key was there before, with the first one of that key; texts stay where they are."""
    text = F.col("text")
    rows = documents(spark, d, "doc_id", "text").select("doc_id", F.length(text).cast("long").alias("size"), F.md5(text).alias("text_md5"), F.md5(T.match_key(text)).alias("key"))
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "size", "text_md5")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = rows.join(first, "key").where("doc_id <> f.doc_id")
    return pairs.select("doc_id", F.col("f.doc_id").alias("first_id"), F.col("size").alias("n_src"), F.col("f.size").alias("n_gold"), (F.col("text_md5") == F.col("f.text_md5")).alias("clean"))


@query()
def rule_pack_findings(spark: SparkSession, d: str) -> DataFrame:
    """The whole pack of pattern rules over all sentences, with its guards."""
    found = rules.guarded_findings(sentences(spark, d).select("doc_id", "lang", "sentence"), "sentence", rules.NEUTRAL + rules.RUSSIAN)
    return found.groupBy("lang", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, event_type = 'error' AS u, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS depth FROM r),
l AS (SELECT *, min(depth) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM o)
SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM l WHERE NOT u AND coalesce(low, depth) >= depth GROUP BY ALL""")
def undo_log(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that stand after all undo steps."""
    log = readers.table(spark, d, "events").select("user_id", "event_id", "event_type")
    left = review.undone(log, ["user_id"], "event_id", F.col("event_type") == "error")
    return left.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query(rf"""WITH g AS (SELECT lang, string_split_regex(text, '[\pL\pN]+(?:[-‑][\pL\pN]+)*') AS parts FROM documents) SELECT lang, CAST(sum(len(list_filter(parts[2:len(parts) - 1], lambda x: x = ' '))) AS BIGINT) AS n_places FROM g GROUP BY lang""")
def comma_places(spark: SparkSession, d: str) -> DataFrame:
    """Places where the generator may put a comma."""
    t = F.col("text")
    return documents(spark, d, "lang", "text").groupBy("lang").agg(F.sum(F.size(synth.comma_places(cleaning.gaps(t)))).alias("n_places"))


@query()
def training_examples(spark: SparkSession, d: str) -> DataFrame:
    """Corrupted sentences that differ from their originals and that the labels restore."""
    rows = sentences(spark, d).withColumn("key", F.concat_ws(":", "doc_id", "para_no", "sent_no"))
    return synth.examples(rows, "sentence", "key", "seed-2").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_SENTENCES} SELECT lang, count(*) AS n, count(*) AS n_restored FROM sentences GROUP BY lang""")
def corrupt_restore(spark: SparkSession, d: str) -> DataFrame:
    """Corrupt every sentence and undo it by the labels: all are restored."""
    rows = sentences(spark, d).withColumn("key", F.concat_ws(":", "doc_id", "para_no", "sent_no"))
    out = synth.corrupted(rows, "sentence", "key", "seed-1")
    same = synth.restored(F.col("corrupted.text"), F.col("corrupted.comma")) == F.col("sentence")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_restored"))


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, length(text) - coalesce(length(lag(text) OVER w), 0) AS growth, count(*) OVER (PARTITION BY conv_id) AS n_turns
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def conversation_turn_lag(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    growth = F.length("text") - F.coalesce(F.length(F.lag("text").over(w)), F.lit(0))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return readers.table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), growth.cast("long").alias("growth"), n.alias("n_turns"))


@query("""SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
 GROUP BY user_id, event_type, island""")
def equal_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return spans.runs(rows, ["user_id"], ["event_id"], "event_type").select("user_id", "event_type", "first", "last", "n")


@query("""WITH marks AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) % 3 = 0 AS open FROM documents)
SELECT a.doc_id, a.source, coalesce((SELECT min(b.doc_id) FROM marks b WHERE b.source = a.source AND b.open AND b.doc_id > a.doc_id), (SELECT min(b.doc_id) FROM marks b WHERE b.source = a.source AND b.open)) AS next_open FROM marks a""")
def next_open_mark(spark: SparkSession, d: str) -> DataFrame:
    """The next open mark, wrapping around: within a range of ids by a window, from range to range by their first marks."""
    docs = documents(spark, d, "doc_id", "source")
    rows = sampling.ordered_rank(docs, ["source"], "doc_id").withColumns({"mark": F.when(F.col("rank") % 3 == 0, F.col("doc_id")), "part": sampling.range_group(docs, "doc_id")})
    parts, w = rows.groupBy("source", "part").agg(F.min("mark").alias("first")), Window.partitionBy("source")
    later = F.first("first", ignorenulls=True).over(w.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    parts = parts.select("source", "part", F.coalesce(later, F.min("first").over(w)).alias("later"))
    own = F.first("mark", ignorenulls=True).over(Window.partitionBy("source", "part").orderBy("doc_id").rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("own", own).join(parts, ["source", "part"]).select("doc_id", "source", F.coalesce("own", "later").alias("next_open"))


def finding_events(spark: SparkSession, d: str) -> DataFrame:
    return finding_columns(readers.table(spark, d, "events"))


def finding_columns(e: DataFrame) -> DataFrame:
    """Findings made from events: several stages and versions a place."""
    return e.select(
        (F.col("user_id") % 50).alias("doc_id"), (F.col("event_id") % 7).cast("int").alias("start"), (F.col("event_id") % 7 + 2).cast("int").alias("end"), (F.length("event_type") % 4).cast("int").alias("rank"),
        F.col("event_type").alias("rule"), F.lit("x").alias("fix"), (F.col("event_type") == "purchase").alias("decided"), (F.col("event_id") % 3).cast("int").alias("version"), F.col("event_id").alias("arrival"))


_UPSERT = """WITH f AS (SELECT user_id % 50 AS doc_id, CAST(event_id % 7 AS INTEGER) AS start, CAST(event_id % 7 + 2 AS INTEGER) AS "end", CAST(length(event_type) % 4 AS INTEGER) AS rank, event_type AS rule,
 event_type = 'purchase' AS decided, CAST(event_id % 3 AS INTEGER) AS version, event_id FROM events), n AS (SELECT *, max(version) OVER (PARTITION BY doc_id, start) AS v FROM f)
SELECT doc_id, start, "end", rank, rule, 'x' AS fix, decided, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY decided DESC, CASE WHEN decided THEN event_id END, rank DESC, rule) AS r FROM n WHERE version = v) WHERE r = 1"""


@query(_UPSERT)
def findings_upsert(spark: SparkSession, d: str) -> DataFrame:
    from corpuslab.streaming import findings as stream

    return stream.upserted_batch(finding_events(spark, d))


@query(_UPSERT)
def stream_findings_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stateful stream over the event files."""
    from corpuslab.streaming import events, findings as stream

    rows = finding_columns(events.event_stream(spark, d))
    return events.drained(stream.upserted(rows), "update", stream.KEYS)


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'bad' ELSE 'unlabelled' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY reason")
def label_left_join(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "doc_id").join(readers.table(spark, d, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "bad").otherwise("unlabelled")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


