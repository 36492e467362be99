"""Queries of evaluation: matches, thresholds, ensembles, bootstrap, on predictions derived from hashes of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import hashing as H
from corpuslab.operators import profile, scoring
from corpuslab.plans.corpus import documents, words
from corpuslab.plans.registry import SQL_WORDS, query, sql_uniform
from corpuslab.sources import readers

_P = sql_uniform("'m1'", "doc_id", "word_no")
_G = sql_uniform("'gold'", "doc_id", "word_no")
THRESHOLDS = [0.3, 0.5, 0.7, 0.8, 0.9, 0.95]


def scored_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of a document with a gold flag and a score that leans to it."""
    rows = words(spark, d).select("doc_id", "lang", "word_no")
    p, g = H.md5_uniform("m1", F.col("doc_id"), F.col("word_no")), H.md5_uniform("gold", F.col("doc_id"), F.col("word_no"))
    return rows.withColumn("p", p).withColumn("gold", (g + p) / 2 > 0.7)


_PLACES = f"WITH {SQL_WORDS}, places AS (SELECT doc_id, lang, word_no, {_P} AS p, ({_G} + {_P}) / 2 > 0.7 AS gold FROM words)"
_F05 = "CASE WHEN tp > 0 THEN round(1.25 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / (0.25 * (tp / greatest(1, tp + fp)) + tp / greatest(1, tp + fn)), 6) ELSE 0 END"
_GRID = f"""grid AS (SELECT lang, t AS threshold, count(*) FILTER (WHERE p >= t AND gold) AS tp, count(*) FILTER (WHERE p >= t AND NOT gold) AS fp, count(*) FILTER (WHERE p < t AND gold) AS fn
 FROM places, (SELECT unnest({THRESHOLDS}) AS t) GROUP BY ALL)"""


@query(f"""{_PLACES}, g AS (SELECT doc_id, lang, word_no FROM places WHERE gold), s AS (SELECT doc_id, lang, word_no FROM places WHERE p >= 0.8), j AS (SELECT coalesce(g.lang, s.lang) AS lang, g.doc_id IS NOT NULL AS a, s.doc_id IS NOT NULL AS b FROM g FULL JOIN s USING (doc_id, lang, word_no)),
c AS (SELECT lang, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE b AND NOT a) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn FROM j GROUP BY lang)
SELECT *, round(tp / greatest(1, tp + fp), 3) AS precision, round(tp / greatest(1, tp + fn), 3) AS recall FROM c""")
def edit_score_full_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_words(spark, d)
    keys = ["doc_id", "lang", "word_no"]
    both = scoring.matched(rows.where("gold").select(keys), rows.where("p >= 0.8").select(keys), keys)
    return scoring.precision_recall(both, ["lang"])


@query(f"{_PLACES}, {_GRID} SELECT *, {_F05} AS f05 FROM grid")
def threshold_grid_f05(spark: SparkSession, d: str) -> DataFrame:
    table = scoring.threshold_table(scored_words(spark, d), THRESHOLDS, ["lang"])
    return table.withColumn("f05", scoring.f_half(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"""{_PLACES}, {_GRID}, rated AS (SELECT *, {_F05} AS f05 FROM grid WHERE fp <= 0.5 * (tp + fn))
SELECT lang, threshold, tp, fp, fn, f05 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f05 DESC, threshold DESC) AS r FROM rated) WHERE r = 1""")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    table = scoring.threshold_table(scored_words(spark, d), THRESHOLDS, ["lang"])
    return scoring.best_threshold(table, ["lang"], 0.5 * (F.col("tp") + F.col("fn")))


_MODELS = f"""WITH {SQL_WORDS}, preds AS (SELECT doc_id, word_no, m AS model, ((('0x' || left(md5(concat_ws('|', 'm' || m, doc_id, word_no)), 8))::BIGINT + 0.5) / 4294967296.0) AS p
 FROM words, (SELECT unnest([1, 2, 3]) AS m) WHERE NOT (m = 3 AND word_no % 7 = 0))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Scores of three models; the third one lacks some places."""
    rows = words(spark, d).select("doc_id", "word_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model")).where("not (model = 3 and word_no % 7 = 0)")
    digest = F.md5(F.concat_ws("|", F.concat(F.lit("m"), F.col("model").cast("string")), F.col("doc_id").cast("string"), F.col("word_no").cast("string")))
    return rows.withColumn("p", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0)


@query(f"""{_MODELS}, c AS (SELECT doc_id, word_no, min(p) AS lo, avg(p) AS mean, max(p) AS hi, min_by(p, model) AS first FROM preds GROUP BY ALL HAVING count(*) = 3)
SELECT how, count(*) AS n, count(*) FILTER (WHERE p >= 0.5) AS n_above, round(sum(p), 4) AS total FROM (SELECT 'min' AS how, lo AS p FROM c UNION ALL SELECT 'mean', mean FROM c UNION ALL SELECT 'max', hi FROM c UNION ALL SELECT 'first', first FROM c) GROUP BY how""")
def ensemble_combine(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).groupBy("doc_id", "word_no").agg(*[f("p").alias(how) for how, f in scoring.COMBINERS.items()], F.count(F.lit(1)).alias("k")).where("k = 3")
    long = rows.select(*scoring.COMBINERS).unpivot([], list(scoring.COMBINERS), "how", "p")
    return long.groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= 0.5).alias("n_above"), F.round(F.sum("p"), 4).alias("total"))


@query(f"""{_MODELS}, subsets AS (SELECT a, b FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([1, 2, 3]) AS b) WHERE a <= b)
SELECT CAST(a AS INTEGER) AS model_a, CAST(b AS INTEGER) AS model_b, count(*) AS n, count(*) FILTER (WHERE least(x.p, y.p) >= 0.5) AS n_agree FROM subsets JOIN preds x ON x.model = a JOIN preds y ON y.model = b AND x.doc_id = y.doc_id AND x.word_no = y.word_no GROUP BY ALL""")
def positional_model_join(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each pair of models: one pivoted aggregate instead of joins of every pair."""
    wide = predictions(spark, d).groupBy("doc_id", "word_no").pivot("model", [1, 2, 3]).agg(F.first("p"))
    pairs = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a <= b]
    sums = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.count_if(F.col(str(a)).isNotNull() & F.col(str(b)).isNotNull()).alias("n"), F.count_if((F.col(str(a)) >= 0.5) & (F.col(str(b)) >= 0.5)).alias("n_agree")) for a, b in pairs]
    return wide.agg(F.array(*sums).alias("s")).select(F.inline("s"))


@query(f"""{_PLACES}, k AS (SELECT lang, CASE WHEN p >= 0.8 AND gold THEN 'exact' WHEN p >= 0.8 THEN 'false' WHEN gold AND p >= 0.5 THEN 'flagged' WHEN gold THEN 'missed' ELSE 'quiet' END AS verdict FROM places) SELECT lang, verdict, count(*) AS n FROM k GROUP BY ALL""")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    p, gold = F.col("p"), F.col("gold")
    verdict = F.when((p >= 0.8) & gold, "exact").when(p >= 0.8, "false").when(gold & (p >= 0.5), "flagged").when(gold, "missed").otherwise("quiet")
    return scored_words(spark, d).groupBy("lang", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_W = "+".join(f"CAST(u > {s} AS INTEGER)" for s in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015))


@query(f"""{_PLACES}, unit AS (SELECT doc_id, sum(CASE WHEN p >= 0.8 AND gold THEN 1 WHEN p >= 0.8 THEN -1 ELSE 0 END) AS gain FROM places GROUP BY doc_id),
drawn AS (SELECT r, gain, {sql_uniform("'boot'", 'r', 'doc_id')} AS u FROM unit, (SELECT unnest(range(1, 101)) AS r)), sums AS (SELECT r, sum(gain * ({_W})) AS total FROM drawn GROUP BY r)
SELECT quantile_cont(total, 0.025) AS low, quantile_cont(total, 0.975) AS high, avg(CAST(total > 0 AS INTEGER)) AS p_gain FROM sums""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    gain = F.when((F.col("p") >= 0.8) & F.col("gold"), 1).when(F.col("p") >= 0.8, -1).otherwise(0)
    return scoring.bootstrap(scored_words(spark, d), "doc_id", gain, 100, "boot")


@query(f"""{_PLACES}, f AS (SELECT lang, CASE WHEN word_no < 50 THEN 'begin' WHEN word_no < 200 THEN 'middle' ELSE 'end' END AS place, CAST(gold AS INTEGER) AS e FROM places)
SELECT 'lang' AS feature, lang AS value, CAST(sum(e) AS BIGINT) AS events, count(*) AS places FROM f GROUP BY lang UNION ALL SELECT 'place', place, CAST(sum(e) AS BIGINT), count(*) FROM f GROUP BY place""")
def event_rate_tables(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("word_no") < 50, "begin").when(F.col("word_no") < 200, "middle").otherwise("end")
    rows = scored_words(spark, d).select("lang", place.alias("place"), F.col("gold").cast("int").alias("e"))
    return profile.event_tables(rows, ["lang", "place"], "e")


@query()
def log_linear_fit(spark: SparkSession, d: str) -> DataFrame:
    """Poisson log-linear weights fitted on the aggregated combinations of two features, over all words."""
    place = F.when(F.col("word_no") < 50, "begin").when(F.col("word_no") < 200, "middle").otherwise("end")
    rows = scored_words(spark, d).groupBy("lang", place.alias("place")).agg(F.sum(F.col("gold").cast("long")).alias("e"), F.count(F.lit(1)).alias("n"))
    fit = profile.fit_log_linear(rows, ["lang", "place"], "e", "n")
    return spark.createDataFrame([(f, v, round(w, 6)) for (f, v), w in sorted(fit.items())], "feature string, value string, weight double")


@query(r"""WITH j AS (SELECT quality = 1 AS gold, len(regexp_extract_all(text, '[*%&$#|!]')) < 0.02 * length(text) AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE gold AND said) AS tp, count(*) FILTER (WHERE said AND NOT gold) AS fp, count(*) FILTER (WHERE gold AND NOT said) AS fn FROM j)
SELECT *, round(tp / greatest(1, tp + fp), 3) AS precision, round(tp / greatest(1, tp + fn), 3) AS recall FROM c""")
def label_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    said = F.regexp_count("text", F.lit("[*%&$#|!]")) < 0.02 * F.length("text")
    rows = documents(spark, d, "doc_id", "text").join(readers.table(spark, d, "labels"), "doc_id")
    verdict = F.when((F.col("quality") == 1) & said, "tp").when(said, "fp").when(F.col("quality") == 1, "fn").otherwise("tn")
    return scoring.precision_recall(rows.select(verdict.alias("verdict")), [])


@query(f"""{_PLACES}, w AS (SELECT lang, word_no, p, 0.9 * p / avg(p) OVER (PARTITION BY lang) + 0.1 AS x FROM places) SELECT lang, round(avg(ln(x)), 6) AS mean_offset FROM w GROUP BY lang""")
def heuristic_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_words(spark, d).select("lang", "p")
    x = 0.9 * F.col("p") / F.col("mean") + 0.1
    return rows.join(rows.groupBy("lang").agg(F.avg("p").alias("mean")), "lang").select("lang", F.log(x).alias("x")).groupBy("lang").agg(F.round(F.avg("x"), 6).alias("mean_offset"))
