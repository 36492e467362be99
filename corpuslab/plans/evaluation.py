"""Queries of evaluation: edits against gold with disputed ranges, matches, votes, variants, folds, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import hashing as H
from corpuslab.functions import text as T
from corpuslab.operators import evaluation as E
from corpuslab.operators import sampling
from corpuslab.plans.corpus import documents, sentences, words
from corpuslab.plans.registry import SQL_SENTENCES, SQL_WORDS, query, sql_count, sql_uniform
from corpuslab.plans.scores import _F05, _MODELS, _PLACES, THRESHOLDS, predictions, scored_words
from corpuslab.sources import readers

KEYS = ["doc_id"]
#: Edits over all words: gold, what a system says, and ranges that are disputed.
_EDITS = rf"""WITH {SQL_WORDS}, gold AS (SELECT doc_id, lang, word_no AS i1, word_no + 1 AS i2, lower(word) AS after FROM words WHERE length(word) >= 10),
sys AS (SELECT doc_id, lang, word_no AS i1, word_no + 1 AS i2, CASE WHEN length(word) % 2 = 0 THEN lower(word) ELSE word || '?' END AS after, CASE WHEN regexp_matches(word, '^\p{{Lu}}') THEN 'CAPITAL' ELSE 'LONG' END AS rule
 FROM words WHERE length(word) >= 9 AND right(word, 1) <> 's'),
disputed AS (SELECT doc_id, word_no AS i1, word_no + 2 AS i2 FROM words WHERE length(word) >= 8 AND regexp_matches(word, '^\p{{Lu}}')),
exact AS (SELECT DISTINCT s.doc_id, s.i1 FROM sys s JOIN gold g USING (doc_id, i1, i2, after)),
place AS (SELECT DISTINCT doc_id, i1 FROM (SELECT doc_id, i1, unnest(range(i1, i2 + 1)) AS p FROM sys) JOIN (SELECT doc_id, unnest(range(i1, i2 + 1)) AS p FROM gold) USING (doc_id, p)),
doubt AS (SELECT DISTINCT doc_id, i1 FROM (SELECT doc_id, i1, unnest(range(i1, i2)) AS p FROM sys) JOIN (SELECT doc_id, unnest(range(i1, i2)) AS p FROM disputed) USING (doc_id, p)),
v AS (SELECT s.*, CASE WHEN e.i1 IS NOT NULL THEN 'exact' WHEN p.i1 IS NOT NULL THEN 'place' WHEN d.i1 IS NOT NULL THEN 'disputed' ELSE 'false' END AS verdict, d.i1 IS NOT NULL AS in_doubt
 FROM sys s LEFT JOIN exact e USING (doc_id, i1) LEFT JOIN place p USING (doc_id, i1) LEFT JOIN doubt d USING (doc_id, i1))"""


def edit_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = words(spark, d).select("doc_id", "lang", F.col("word_no").alias("i1"), (F.col("word_no") + 1).alias("i2"), "word")
    size, capital = F.length("word"), F.col("word").rlike(r"^\p{Lu}")
    gold = rows.where(size >= 10).select("doc_id", "lang", "i1", "i2", F.lower("word").alias("after"))
    after = F.when(size % 2 == 0, F.lower("word")).otherwise(F.concat("word", F.lit("?")))
    system = rows.where((size >= 9) & (F.right("word", F.lit(1)) != "s")).select("doc_id", "lang", "i1", "i2", after.alias("after"), F.when(capital, "CAPITAL").otherwise("LONG").alias("rule"))
    disputed = rows.where((size >= 8) & capital).select("doc_id", "i1", (F.col("i1") + 2).alias("i2"))
    return gold, system, disputed


@query(f"{_EDITS} SELECT lang, rule, verdict, count(*) AS n FROM v GROUP BY ALL")
def verdict_classes(spark: SparkSession, d: str) -> DataFrame:
    """System edits by rule: exact, at a gold place, disputed or false."""
    gold, system, disputed = edit_tables(spark, d)
    return E.classified(system, gold, disputed, KEYS).groupBy("lang", "rule", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_EDITS}, j AS (SELECT coalesce(g.lang, v.lang) AS lang, g.i1 IS NOT NULL AS g, v.i1 IS NOT NULL AS s, coalesce(v.in_doubt, false) AS x FROM gold g FULL JOIN v USING (doc_id, lang, i1, i2, after))
SELECT lang, count(*) FILTER (WHERE g AND s) AS tp, count(*) FILTER (WHERE s AND NOT g AND x) AS ignored, count(*) FILTER (WHERE s AND NOT g AND NOT x) AS fp, count(*) FILTER (WHERE g AND NOT s) AS fn FROM j GROUP BY lang""")
def gold_system_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of system edits against gold; what lies in a disputed range is ignored."""
    gold, system, disputed = edit_tables(spark, d)
    return E.scored(system, gold, disputed, KEYS, ["lang"])


@query(f"""{_EDITS}, m AS (SELECT g.doc_id, g.i1, g.lang, min(s.rule || '|' || lpad(CAST(s.i1 AS VARCHAR), 9, '0')) AS match FROM (SELECT *, unnest(range(i1, i2 + 1)) AS p FROM gold) g
 LEFT JOIN (SELECT doc_id, rule, i1, unnest(range(i1, i2 + 1)) AS p FROM sys) s ON s.doc_id = g.doc_id AND s.p = g.p GROUP BY ALL)
SELECT lang, coalesce(split_part(match, '|', 1), 'none') AS rule, count(*) AS n FROM m GROUP BY ALL""")
def first_match_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """Each gold edit with the first finding at its place, by rule."""
    gold, system, _ = edit_tables(spark, d)
    found = E.first_match(gold, system, KEYS, ["rule", "i1"])
    return found.groupBy("lang", F.coalesce("match.rule", F.lit("none")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_EDITS}, c AS (SELECT doc_id, lang, i1, i2, CASE WHEN right(after, 1) = '?' THEN NULL ELSE after END AS fix FROM sys), s AS (SELECT doc_id, i1, i2, CASE WHEN length(after) % 2 = 1 THEN NULL ELSE after END AS fix FROM gold)
SELECT lang, count(*) AS n FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND s.i1 = c.i1 AND s.i2 = c.i2 AND s.fix IS NOT DISTINCT FROM c.fix) GROUP BY lang""")
def span_vote_join(spark: SparkSession, d: str) -> DataFrame:
    """Hidden candidates that an earlier finding with the same span and fix confirms; no fix equals no fix."""
    gold, system, _ = edit_tables(spark, d)
    c = system.select("doc_id", "lang", "i1", "i2", F.when(~F.col("after").endswith("?"), F.col("after")).alias("fix"))
    s = gold.select("doc_id", "i1", "i2", F.when(F.length("after") % 2 == 0, F.col("after")).alias("fix"))
    return E.voted(c, s, ["doc_id", "i1", "i2", "fix"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_LABELLED = f"{_MODELS}, l AS (SELECT *, CASE WHEN p < 0.3 THEN 'KEEP' WHEN p < 0.65 THEN 'A' ELSE 'B' END AS label FROM preds)"


@query(f"""{_LABELLED}, f AS (SELECT 'first' AS how, min_by(label, model) AS label FROM l GROUP BY doc_id, word_no UNION ALL
SELECT 'max', label FROM (SELECT label, row_number() OVER (PARTITION BY doc_id, word_no ORDER BY CASE WHEN label <> 'KEEP' THEN p ELSE -1 END DESC, model) AS r FROM l) WHERE r = 1 UNION ALL
SELECT 'agreed', CASE WHEN min(label) = max(label) THEN min(label) ELSE 'KEEP' END FROM l GROUP BY doc_id, word_no) SELECT how, label, count(*) AS n FROM f GROUP BY ALL""")
def soft_form_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of three models combined in three ways."""
    p = F.col("p")
    rows = predictions(spark, d).withColumn("label", F.when(p < 0.3, "KEEP").when(p < 0.65, "A").otherwise("B"))
    parts = [E.soft_label(rows, ["doc_id", "word_no"], how).groupBy(F.lit(how).alias("how"), "label").agg(F.count(F.lit(1)).alias("n")) for how in E.SOFT]
    return parts[0].union(parts[1]).union(parts[2])


_HEADS = rf"""{_PLACES}, h AS (SELECT CASE WHEN regexp_matches(word, '\d') THEN 'IGNORE' WHEN length(word) < 5 THEN 'A' WHEN length(word) < 9 THEN 'B' ELSE 'C' END AS gold,
 CASE WHEN regexp_matches(lower(word), '^[a-f]') THEN 'A' WHEN regexp_matches(lower(word), '^[g-p]') THEN 'B' ELSE 'C' END AS said FROM words), k AS (SELECT * FROM h WHERE gold <> 'IGNORE')"""


@query(f"""{_HEADS} SELECT label, count(*) FILTER (WHERE gold = label AND said = label) AS tp, count(*) FILTER (WHERE gold <> label AND said = label) AS fp, count(*) FILTER (WHERE gold = label AND said <> label) AS fn
 FROM k, (SELECT unnest(['A', 'B', 'C']) AS label) WHERE gold = label OR said = label GROUP BY label""")
def head_metrics_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by label, without the words that carry the ignored label."""
    w, n = F.lower("word"), F.length("word")
    gold = F.when(F.col("word").rlike(r"\d"), "IGNORE").when(n < 5, "A").when(n < 9, "B").otherwise("C")
    said = F.when(w.rlike("^[a-f]"), "A").when(w.rlike("^[g-p]"), "B").otherwise("C")
    return E.head_metrics(words(spark, d).select(gold.alias("gold"), said.alias("said")), "gold", "said", "IGNORE")


@query(rf"""{_EDITS}, g AS (SELECT v.*, length(after) > 12 AS a, rule = 'CAPITAL' AS b, i1 = 0 AS c FROM v), grid AS (SELECT unnest(range(0, 8)) AS m),
k AS (SELECT m, count(*) FILTER (WHERE NOT (m & 1 > 0 AND a) AND NOT (m & 2 > 0 AND b) AND NOT (m & 4 > 0 AND c)) AS n_kept,
 count(*) FILTER (WHERE verdict = 'exact' AND NOT (m & 1 > 0 AND a) AND NOT (m & 2 > 0 AND b) AND NOT (m & 4 > 0 AND c)) AS n_right FROM g, grid GROUP BY m)
SELECT array_to_string(list_filter([CASE WHEN m & 1 > 0 THEN 'long' END, CASE WHEN m & 2 > 0 THEN 'capital' END, CASE WHEN m & 4 > 0 THEN 'start' END], lambda x: x IS NOT NULL), '+') AS guards, n_kept, n_right FROM k""")
def guard_ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every subset of three guards: edits that pass, and right ones among them."""
    gold, system, disputed = edit_tables(spark, d)
    rows = E.classified(system, gold, disputed, KEYS)
    guards = {"long": F.length("after") > 12, "capital": F.col("rule") == "CAPITAL", "start": F.col("i1") == 0}
    return E.flag_grid(rows, guards, F.col("verdict") == "exact")


_FOLDS = f"""{_PLACES}, folds AS (SELECT doc_id, CAST((dense_rank() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 2 AS INTEGER) AS fold FROM documents),
own AS (SELECT lang, fold, CAST(sum(CAST(gold AS INTEGER)) AS BIGINT) AS events, count(*) AS places FROM places JOIN folds USING (doc_id) GROUP BY ALL),
cv AS (SELECT o.*, sum(events) OVER (PARTITION BY lang) - events AS other_events, sum(places) OVER (PARTITION BY lang) - places AS other_places FROM own o)"""


def folded(spark: SparkSession, d: str) -> DataFrame:
    ranked = sampling.ordered_rank(documents(spark, d, "doc_id", "lang"), ["lang"], "doc_id")
    folds = ranked.select("doc_id", ((F.col("rank") - 1) % 2).cast("int").alias("fold"))
    counts = scored_words(spark, d).groupBy("doc_id", "lang").agg(F.sum(F.col("gold").cast("long")).alias("e"), F.count(F.lit(1)).alias("n"))
    return counts.join(folds, "doc_id")


@query(f"""{_FOLDS} SELECT lang, fold, events, CAST(other_events AS BIGINT) AS other_events, round(events * ln((other_events + 0.5) / (other_places + 1.0)) + (places - events) * ln(1 - (other_events + 0.5) / (other_places + 1.0)), 4) AS log_likelihood FROM cv""")
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Two folds by document: the rate of the one judged on the other."""
    rows = folded(spark, d).groupBy("lang", "fold").agg(F.sum("e").alias("events"), F.sum("n").alias("places"))
    whole = rows.groupBy("lang").agg(F.sum("events").alias("_e"), F.sum("places").alias("_n"))
    rows = rows.join(whole, "lang").withColumns({"other_events": F.col("_e") - F.col("events"), "other_places": F.col("_n") - F.col("places")})
    rate = E.smoothed(F.col("other_events"), F.col("other_places"))
    log = F.col("events") * F.log(rate) + (F.col("places") - F.col("events")) * F.log(1 - rate)
    return rows.select("lang", "fold", "events", "other_events", F.round(log, 4).alias("log_likelihood"))


@query(f"""{_FOLDS}, whole AS (SELECT fold, sum(other_events) AS oe, sum(other_places) AS op FROM cv GROUP BY fold)
SELECT fold, round(sum(events * ln(((other_events + 0.5) / (other_places + 1.0)) / ((oe + 0.5) / (op + 1.0))) - places * ((other_events + 0.5) / (other_places + 1.0) - (oe + 0.5) / (op + 1.0))) / sum(events), 6) AS gain FROM cv JOIN whole USING (fold) GROUP BY fold""")
def heldout_gain(spark: SparkSession, d: str) -> DataFrame:
    """Poisson log-likelihood an event that rates by language gain over one rate, on held-out documents."""
    rows = folded(spark, d).groupBy("lang", "fold").agg(F.sum("e").alias("events"), F.sum("n").alias("places"))
    sums = rows.groupBy("lang").agg(F.sum("events").alias("_e"), F.sum("places").alias("_n"))
    rows = rows.join(sums, "lang").withColumns({"oe": F.col("_e") - F.col("events"), "op": F.col("_n") - F.col("places")})
    one = rows.groupBy("fold").agg(F.sum("oe").alias("we"), F.sum("op").alias("wp"))
    rate, flat = E.smoothed(F.col("oe"), F.col("op")), E.smoothed(F.col("we"), F.col("wp"))
    gain = F.col("events") * F.log(rate / flat) - F.col("places") * (rate - flat)
    return rows.join(one, "fold").groupBy("fold").agg(F.round(F.sum(gain) / F.sum("events"), 6).alias("gain"))


_W = "+".join(f"CAST(u > {s} AS INTEGER)" for s in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015))


@query(f"""{_PLACES}, unit AS (SELECT doc_id, t AS threshold, count(*) FILTER (WHERE p >= t AND gold) AS tp, count(*) FILTER (WHERE p >= t AND NOT gold) AS fp, count(*) FILTER (WHERE p < t AND gold) AS fn FROM places, (SELECT unnest({THRESHOLDS}) AS t) GROUP BY ALL),
drawn AS (SELECT r, unit.*, {sql_uniform("'stable'", 'r', 'doc_id')} AS u FROM unit, (SELECT unnest(range(1, 41)) AS r)), sums AS (SELECT r, threshold, sum(tp * ({_W})) AS tp, sum(fp * ({_W})) AS fp, sum(fn * ({_W})) AS fn FROM drawn GROUP BY ALL),
best AS (SELECT r, threshold, row_number() OVER (PARTITION BY r ORDER BY {_F05} DESC, threshold DESC) AS o FROM sums) SELECT threshold, count(*) AS n FROM best WHERE o = 1 GROUP BY threshold""")
def selection_stability(spark: SparkSession, d: str) -> DataFrame:
    """How often each threshold wins over forty resamples of the documents."""
    from corpuslab.operators import scoring

    units = scoring.threshold_table(scored_words(spark, d), THRESHOLDS, ["doc_id"])
    return E.selection_stability(units, "doc_id", THRESHOLDS, 40, "stable")


@query(f"""{_EDITS}, f AS (SELECT doc_id, i1, 'gold' AS src FROM gold UNION ALL SELECT doc_id, i1, rule FROM sys) SELECT * FROM (SELECT 'rules' AS system, count(DISTINCT (doc_id, i1)) AS n FROM f WHERE src = 'CAPITAL' UNION ALL
SELECT 'model', count(DISTINCT (doc_id, i1)) FROM f WHERE src = 'LONG' UNION ALL SELECT 'both', count(DISTINCT (doc_id, i1)) FROM f WHERE src IN ('CAPITAL', 'LONG') UNION ALL SELECT 'all', count(DISTINCT (doc_id, i1)) FROM f)""")
def system_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Places found by combinations of sources."""
    gold, system, _ = edit_tables(spark, d)
    found = gold.select("doc_id", "i1", F.lit("gold").alias("source")).union(system.select("doc_id", "i1", "rule"))
    return E.combined_sources(found, "source", ["doc_id", "i1"], {"rules": ["CAPITAL"], "model": ["LONG"], "both": ["CAPITAL", "LONG"], "all": ["CAPITAL", "LONG", "gold"]})


@query(f"""{_EDITS}, c AS (SELECT rule, CASE WHEN length(after) < 10 THEN 'short' WHEN length(after) < 13 THEN 'middle' ELSE 'long' END AS class, verdict FROM v),
p AS (SELECT unnest(['short', 'safe', 'all']) AS variant, unnest([['short'], ['short', 'middle'], ['short', 'middle', 'long']]) AS classes)
SELECT variant, count(*) AS n, count(*) FILTER (WHERE verdict = 'exact') AS n_right, count(*) FILTER (WHERE verdict = 'false') AS n_false FROM c JOIN p ON list_contains(p.classes, c.class) GROUP BY variant""")
def policy_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants of a policy as data: which classes pass, and how right they are; edits are counted once by class."""
    gold, system, disputed = edit_tables(spark, d)
    n = F.length("after")
    rows = E.classified(system, gold, disputed, KEYS).withColumn("class", F.when(n < 10, "short").when(n < 13, "middle").otherwise("long"))
    counts = rows.groupBy("class", "verdict").agg(F.count(F.lit(1)).alias("k"))
    variants = spark.createDataFrame([("short", ["short"]), ("safe", ["short", "middle"]), ("all", ["short", "middle", "long"])], "variant string, classes array<string>")
    joined = counts.join(F.broadcast(variants.select("variant", F.explode("classes").alias("class"))), "class")
    one = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("k")).otherwise(0))
    return joined.groupBy("variant").agg(F.sum("k").alias("n"), one("exact").alias("n_right"), one("false").alias("n_false"))


@query(f"""{_PLACES} SELECT CAST(floor(p * 10) AS INTEGER) AS band, count(*) AS n, count(*) FILTER (WHERE gold) AS n_right, count(*) FILTER (WHERE p >= 0.8 AND NOT gold) AS n_false FROM places GROUP BY band""")
def agreement_bands(spark: SparkSession, d: str) -> DataFrame:
    """Scores in bands of a tenth: how many are right in each."""
    rows = scored_words(spark, d)
    return rows.groupBy(F.floor(F.col("p") * 10).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("gold").alias("n_right"), F.count_if((F.col("p") >= 0.8) & ~F.col("gold")).alias("n_false"))


@query(f"""{_EDITS} SELECT CASE WHEN length(after) < 12 THEN 'short' ELSE 'long' END AS class, verdict, count(*) AS n FROM v WHERE NOT EXISTS (SELECT 1 FROM disputed d WHERE d.doc_id = v.doc_id AND d.i1 = v.i1) GROUP BY ALL""")
def candidate_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by class and verdict, without those that a disputed range begins at."""
    gold, system, disputed = edit_tables(spark, d)
    rest = E.classified(system, gold, disputed, KEYS).join(disputed.select("doc_id", "i1").distinct(), ["doc_id", "i1"], "left_anti")
    return rest.groupBy(F.when(F.length("after") < 12, "short").otherwise("long").alias("class"), "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_EDITS} SELECT CASE WHEN i1 < 20 THEN 'begin' ELSE 'rest' END AS context, rule, count(*) AS n, count(*) FILTER (WHERE verdict = 'exact') AS tp, count(*) FILTER (WHERE verdict = 'false') AS fp FROM v GROUP BY ALL""")
def divergence_by_context(spark: SparkSession, d: str) -> DataFrame:
    """Rules by where they fire: right and false ones."""
    gold, system, disputed = edit_tables(spark, d)
    rows = E.classified(system, gold, disputed, KEYS)
    return rows.groupBy(F.when(F.col("i1") < 20, "begin").otherwise("rest").alias("context"), "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "exact").alias("tp"), F.count_if(F.col("verdict") == "false").alias("fp"))


@query(rf"""WITH {SQL_SENTENCES}, o AS (SELECT lang, sentence AS src, trim(regexp_replace(replace(sentence, ' ,', ','), '(\d) (\d)', '\1\2', 'g')) AS out FROM sentences)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE src = out) AS n_same, count(*) FILTER (WHERE regexp_extract_all(src, '\d+') <> regexp_extract_all(out, '\d+')) AS digits_changed, round(avg(length(out)), 4) AS mean_length, max(length(out)) AS longest FROM o GROUP BY lang""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of a rewriting run: unchanged ones, changed digits, lengths."""
    src = F.col("sentence")
    rows = sentences(spark, d).select("lang", src.alias("src"), F.trim(F.regexp_replace(F.replace(src, F.lit(" ,"), F.lit(",")), r"(\d) (\d)", "$1$2")).alias("out"))
    size = F.length("out")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") == F.col("out")).alias("n_same"), F.count_if(T.digit_runs(F.col("src")) != T.digit_runs(F.col("out"))).alias("digits_changed"), F.round(F.avg(size), 4).alias("mean_length"), F.max(size).cast("long").alias("longest"))


@query(rf"""WITH {SQL_SENTENCES}, s AS (SELECT lang, {sql_count("sentence", r"[\pL\pN]+(?:[-‑][\pL\pN]+)*")} AS a, {sql_count("sentence", r"[^ ]+")} AS b, md5(sentence) AS h FROM sentences)
SELECT lang, CASE WHEN a <> b THEN 'fallback' WHEN left(h, 1) < '8' THEN 'agreed' ELSE 'dropped' END AS kind, count(*) AS n FROM s GROUP BY ALL""")
def arbiter_agreement(spark: SparkSession, d: str) -> DataFrame:
    """An edit stays where the second model agrees; where both count different words, the first one is kept as it is."""
    s = F.col("sentence")
    kind = F.when(T.word_count(s) != F.regexp_count(s, F.lit("[^ ]+")), "fallback").when(F.left(F.md5(s), F.lit(1)) < "8", "agreed").otherwise("dropped")
    return sentences(spark, d).groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_MODELS}, m AS (SELECT doc_id, model, count(*) AS n FROM preds GROUP BY ALL), w AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id)
SELECT CAST(model AS INTEGER) AS model, count(*) AS n_docs, count(*) FILTER (WHERE m.n = w.n) AS n_complete FROM w JOIN m USING (doc_id) GROUP BY model""")
def model_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Documents for which a model has predicted every word; a model with a gap is left out there."""
    have = predictions(spark, d).groupBy("doc_id", "model").agg(F.count(F.lit(1)).alias("have"))
    want = documents(spark, d, "doc_id", "text").select("doc_id", T.word_count(F.col("text")).alias("want"))
    return have.join(want, "doc_id").groupBy("model").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("have") == F.col("want")).alias("n_complete"))


@query("""WITH l AS (SELECT doc_id, quality, toxic FROM labels), k AS (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, md5(concat_ws('|', 'epoch', doc_id)), doc_id) AS r FROM l WHERE quality = 1)
SELECT doc_id FROM l WHERE quality = 0 UNION ALL SELECT doc_id FROM k WHERE r <= floor(0.5 * (SELECT count(*) FROM l WHERE quality = 0))""")
def epoch_sample(spark: SparkSession, d: str) -> DataFrame:
    """All errors, hard negatives first, then clean rows up to half as many."""
    labels = readers.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return E.epoch_sample(labels, F.col("quality") == 0, F.col("toxic") == 1, 0.5, "epoch", "doc_id").select("doc_id")


@query("""SELECT user_id, arg_max(event_type, event_id) AS label, max(event_id) AS event_id FROM events GROUP BY user_id""")
def prediction_cache_union(spark: SparkSession, d: str) -> DataFrame:
    """Of several caches the later entry of a key wins."""
    return readers.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("label"), F.max("event_id").alias("event_id"))


@query("""WITH old AS (SELECT doc_id, md5(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT d.doc_id, length(d.text) AS size FROM documents d WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.doc_id = d.doc_id AND old.h = md5(d.text))""")
def dirty_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Only rows whose text differs from the state that was checked are checked again."""
    docs = documents(spark, d, "doc_id", "text").select("doc_id", F.md5("text").alias("h"), F.length("text").cast("long").alias("size"))
    checked = docs.join(readers.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id", "h")
    return docs.join(checked, ["doc_id", "h"], "left_anti").select("doc_id", "size")


@query(f"""WITH u AS (SELECT doc_id, {sql_uniform("'batch'", 'doc_id')} AS u, length(text) AS n FROM documents), b AS (SELECT CAST(floor(u * 64) AS INTEGER) AS batch, n FROM u)
SELECT batch, count(*) AS n, max(n) AS padded_to, CAST(sum(n) AS BIGINT) AS filled, max(n) * count(*) - CAST(sum(n) AS BIGINT) AS padding, CAST(least(count(*) - 1, greatest(1, round(count(*) * 0.3))) AS INTEGER) AS errors FROM b GROUP BY batch""")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches padded to their longest row, with the share of errors that each should hold."""
    from corpuslab.functions import cleaning as C

    n = F.length("text").cast("long")
    rows = documents(spark, d, "doc_id", "text").select(F.floor(H.md5_uniform("batch", F.col("doc_id")) * 64).cast("int").alias("batch"), n.alias("n"))
    out = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("padded_to"), F.sum("n").alias("filled"))
    return out.withColumns({"padding": F.col("padded_to") * F.col("n") - F.col("filled"), "errors": C.errors_per_batch(F.col("n"), F.lit(0.3))})
