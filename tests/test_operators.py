import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import dedup, diff, filters, lexicon, profile, rules, sampling, scoring, spans, synth
from corpuslab.plans import findings as plan_findings
from corpuslab.plans import scores as plan_scores


def findings(spark, rows):
    return spark.createDataFrame([(1, rows)], f"doc_id int, found array<{spans.FINDING}>")


def test_merge_takes_the_highest_rank_first(spark):
    rows = [(0, 5, 1, "A", None), (3, 8, 3, "B", "x"), (7, 9, 2, "C", ""), (8, 8, 1, "D", ","), (9, 9, 1, "E", ",")]
    merged = spans.merged(findings(spark, rows), "found").first()["found"]
    assert [f["rule"] for f in merged] == ["B", "D", "E"]


def test_insertions_overlap_only_inside_or_at_the_same_place(spark):
    rows = [(4, 4, 3, "A", "x"), (4, 4, 2, "B", "y"), (4, 6, 1, "C", "z"), (2, 5, 1, "D", "z")]
    assert [f["rule"] for f in spans.merged(findings(spark, rows), "found").first()["found"]] == ["A", "C"]


def test_merge_against_brute_force_and_on_long_rows(spark):
    rng = random.Random(3)
    rows = [[(a, a + rng.randint(0, 4), rng.randint(1, 3), rng.choice("ABC"), None) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))] for _ in range(60)] + [None]
    over = lambda x, y: x[0] == y[0] if x[0] == x[1] and y[0] == y[1] else y[0] < x[0] < y[1] if x[0] == x[1] else x[0] < y[0] < x[1] if y[0] == y[1] else x[0] < y[1] and y[0] < x[1]
    df = spark.createDataFrame(list(enumerate(rows)), f"doc_id int, found array<{spans.FINDING}>")
    for r in spans.merged(df, "found").collect():
        chosen = []
        for f in sorted(rows[r["doc_id"]] or [], key=lambda f: (-f[2], f[0], f[1], f[3])):
            chosen += [f] * (not any(over(f, k) for k in chosen))
        assert r["found"] is None if rows[r["doc_id"]] is None else [tuple(f) for f in r["found"]] == sorted(chosen)
    long = [(3 * k + 2, 3 * k + 7, 3, "CAPITAL", None) for k in range(20_000)]
    assert len(spans.merged(findings(spark, long), "found").first()["found"]) == 10_000


def test_findings_of_whole_documents_are_merged(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab cd " * 300 + "Extraordinarily Long", "en", "s", 1820)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = plan_findings.merge_findings(spark, str(tmp_path)).collect()
    assert sorted((r["start"], r["rule"]) for r in rows) == [(3 * k, "SHORT") for k in range(600)] + [(1802, "CAPITAL")]


def test_log_linear_query_uses_all_words(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "word " * 123, "en", "s", 615)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counted = []
    monkeypatch.setattr(profile, "fit_log_linear", lambda table, *_: counted.append({r["place"]: r["n"] for r in table.collect()}) or {("lang", "en"): 0.0})
    plan_scores.log_linear_fit(spark, str(tmp_path))
    assert counted == [{"begin": 50, "middle": 73}]


def test_token_diff_finds_the_edits_that_corruption_left(spark, data):
    rows = plan_findings.token_diff(spark, data).collect()
    edits = {}
    for r in rows:
        edits.setdefault(r["lang"], [r["n_labels"], 0])[1] += r["n"]
    assert edits and all(0.99 * labels <= n <= labels for labels, n in edits.values())  # neighbouring edits are one


def test_many_matches_in_one_row(spark):
    text = "ab && " * 50_000
    row = spark.createDataFrame([(1, text), (2, "&&"), (3, ""), (4, None), (5, "x")], "id int, t string").withColumn("found", rules.pattern_spans(F.col("t"), rules.MARK_RUN))
    out = {r["id"]: r for r in spans.apply_fixes(row, "t", "found", "fixed").collect()}
    assert out[1]["fixed"] == "ab  " * 50_000 and [f["start"] for f in out[1]["found"]] == list(range(3, 300_000, 6))
    assert [out[k]["fixed"] for k in (2, 3, 4, 5)] == ["", "", None, "x"]


def test_apply_fixes(spark):
    df = spark.createDataFrame([("abcdef", [(0, 1, 1, "r", "XY"), (2, 2, 1, "r", "-"), (3, 5, 1, "r", ""), (5, 6, 1, "r", None)])], f"t string, found array<{spans.FINDING}>")
    assert spans.apply_fixes(df, "t", "found", "out").first()["out"] == "XYb-cf"


def test_shift_and_runs(spark):
    df = spark.createDataFrame([(1, 2, 4, "xyz"), (1, 6, 6, "!"), (1, 9, 12, "")], "p int, start int, end int, fix string")
    assert [r["shift"] for r in spans.shifted(df, ["p"]).orderBy("start").collect()] == [0, 1, 2]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabba")], "p int, k int, v string")
    assert sorted((r["first"], r["last"], r["n"]) for r in spans.runs(rows, ["p"], ["k"], "v").collect()) == [(0, 1, 2), (2, 3, 2), (4, 4, 1)]


def test_diff_round_trip():
    rng = random.Random(3)
    tokens = ["a", "b", ",", "c-d", ".", "E"]
    for _ in range(200):
        a, b = (" ".join(rng.choice(tokens) for _ in range(rng.randint(0, 9))) for _ in "ab")
        split = lambda s: [t for t in diff.TOKEN.findall(s) if not t.isspace()]
        assert diff.patched(split(a), diff.token_edits(a, b)) == split(b)


def test_edit_kinds(spark):
    pairs = [("one two", "one, two"), ("One two", "one two"), ("note book", "notebook"), ("a cat sat", "a dog sat"), ("a cat", "a big cat"), ("end .", "end !"), ("x y z w", "x a b w")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, src string, gold string")
    kinds = {r["id"]: r["kind"] for r in diff.edit_rows(df, "src", "gold").collect()}
    assert kinds == {0: "comma", 1: "case", 2: "join", 3: "word", 4: "insertion", 5: "mark", 6: "words"}


def test_corrupt_restores():
    rng = random.Random(1)
    for seed in range(60):
        s = " ".join(rng.choice(["Word", "tail,", "two-part", "end;", "ёж,"]) for _ in range(12)) + "."
        bad = synth.corrupt_commas(s, "seed", seed, 0.6, 0.3)
        assert synth.restore_commas(bad["text"], bad["comma"]) == s
        assert sum(x != synth.KEEP for x in bad["comma"]) <= 3
        assert bad == synth.corrupt_commas(s, "seed", seed, 0.6, 0.3)


def test_rules(spark):
    df = spark.createDataFrame([(1, "кто то пришел из за угла и и page12 x"), (2, "кое что"), (3, "ok"), (4, None)], "id int, s string")
    found = rules.pattern_findings(df, "s", rules.RUSSIAN + rules.NEUTRAL)
    text = {1: "кто то пришел из за угла и и page12 x", 2: "кое что"}
    got = {(r["id"], r["rule"]): (text[r["id"]][r["start"] : r["end"]], r["fix"]) for r in found.collect()}
    assert got == {(1, "DEFIS_PARTICLE"): ("кто то", "кто-то"), (1, "IZ_ZA"): ("из за", "из-за"), (1, "GLUED_DIGIT"): ("page12", "page 12"), (2, "DEFIS_KOE"): ("кое что", "кое-что")}


def test_mixed_script(spark):
    df = spark.createDataFrame([("cтол",), ("stol",), ("стол",)], "w string")
    assert [r[0] for r in df.select(rules.mixed_script(F.col("w"))).collect()] == ["стол", None, None]


def test_threshold_findings(spark):
    preds = spark.createDataFrame([("ADD", 0.95), ("ADD", 0.8), ("DEL", 0.8), ("ADD", 0.1)], "label string, p double")
    limits = spark.createDataFrame([("ADD", 0.9, 0.75), ("DEL", 0.9, 0.9)], "label string, error_at double, check_at double")
    assert sorted((r["p"], r["level"]) for r in rules.threshold_findings(preds, limits).collect()) == [(0.8, "check"), (0.95, "error")]


def test_first_wins_and_cascade(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, "b", None), (4, None, "y")], "id int, t string, z string")
    assert sorted(r["id"] for r in dedup.first_wins(df, F.col("t"), F.col("id")).collect()) == [1, 2, 4]
    known = spark.createDataFrame([("b",), ("b",)], "k string")
    out = dedup.cascade(df, F.col("t"), [("seen", known)], F.col("id"))
    assert {r["id"]: r["reason"] for r in out.collect()} == {1: "kept", 3: "duplicate", 2: "seen", 4: "kept"}


def test_overlap_joins_are_complements(spark):
    df = spark.createDataFrame([(i, f"T{i % 4}!") for i in range(12)], "id int, t string")
    known = spark.createDataFrame([("t1",), ("t3",)], "k string")
    key = F.regexp_replace(F.lower("t"), "!", "")
    a, b = (f(df, key, known, F.col("k")).count() for f in (dedup.overlapping, dedup.without_overlap))
    assert (a, b) == (6, 6)


def test_samples_are_deterministic(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 3)
    a, b = (sorted(map(tuple, sampling.capped(df.repartition(n), "s", 4, "x", "id", 2).select("id", "copy").collect())) for n in (1, 7))
    assert a == b and len(a) == 24
    assert sampling.share_of_stratum(df, ["s"], 0.1, "x", "id").count() == 9
    assert sampling.passes(df, 2, "x", "id").groupBy("pass").count().select("count").distinct().collect()[0][0] == 100
    assert sampling.batches(df, 10, "x", "id", "s").groupBy("s", "batch").count().agg(F.max("count")).first()[0] == 10


def test_weighted_order_prefers_heavy_rows(spark):
    df = spark.range(2000).select("id", F.lit("a").alias("s"), F.when(F.col("id") < 200, 50.0).otherwise(1.0).alias("w"))
    top = sampling.weighted_order(df, F.col("w"), "seed", "id", "s", 100)
    assert top.where("id < 200").count() > 60


def test_lexicon(spark):
    known = spark.createDataFrame([("sun", 9), ("flower", 5), ("s", 1), ("unflower", 1)], "word string, n bigint")
    glued = spark.createDataFrame([("sunflower",), ("moon",)], "word string")
    assert [tuple(r) for r in lexicon.split_glued(glued, known).collect()] == [("sunflower", "sun", "flower")]
    rare = spark.createDataFrame([("hause",), ("xouse",), ("mouses",)], "word string")
    often = spark.createDataFrame([("house", 50), ("mouse", 70), ("haus", 20)], "word string, n bigint")
    assert sorted(tuple(r) for r in lexicon.suggest(rare, often).collect()) == [("hause", "house", 50), ("mouses", "mouse", 70)]


def test_filters(spark):
    s = "This is a plain and decent sentence, is it not?"
    rows = [(s, True), ("Too short.", False), (s.replace("plain", "p|ain"), False), (s[:-1], False), ("1 2 3 4 5 6 7 8 9 a.", False)]
    df = spark.createDataFrame(rows, "s string, fit boolean")
    assert all(r[0] == r[1] for r in df.select(filters.checkable(F.col("s")), "fit").collect())
    df = spark.createDataFrame([("kitten", "sitting", 3 / 7), ("", "", 0.0)], "a string, b string, e double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select(filters.changed_share(F.col("a"), F.col("b")), "e").collect())


def test_combine_refuses_unknown_and_needs_all_models(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.6), (2, 1, 0.9)], "place int, model int, p double")
    assert [tuple(r) for r in scoring.combine(df, ["place"], "min", 2).collect()] == [(1, 0.2)]
    with pytest.raises(ValueError):
        scoring.combine(df, ["place"], "median", 2)
    assert len(scoring.model_subsets(["a", "b", "c"], 2)) == 6


def test_bootstrap_brackets_the_gain(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 4 == 0, -1).otherwise(1).alias("g"))
    low, high, p = scoring.bootstrap(df, "id", F.col("g"), 100, "b").first()
    assert low < 100 < high and p == 1.0


def test_log_linear_fit_recovers_rates(spark):
    rows = [(a, b, int(1000 * r * s), 10_000) for a, r in (("x", 1.0), ("y", 2.0)) for b, s in (("u", 1.0), ("v", 0.5))]
    df = spark.createDataFrame(rows, "a string, b string, e bigint, n bigint")
    fit = profile.fit_log_linear(df, ["a", "b"], "e", "n", ridge=1e-6)
    assert abs(fit["a", "y"] - fit["a", "x"] - 0.6931) < 1e-2 and abs(fit["b", "v"] - fit["b", "u"] + 0.6931) < 1e-2
