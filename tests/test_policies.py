"""Policies over single edits and places."""

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import policies as P


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("дом", "дом", "NOUN", ["nomn", "sing", "masc"], 0.9), ("дома", "дом", "NOUN", ["gent", "sing", "masc"], 0.6), ("дома", "дом", "NOUN", ["nomn", "plur", "masc"], 0.4), ("домам", "дом", "NOUN", ["datv", "plur", "masc"], 0.9), ("идёт", "идти", "VERB", ["sing", "3per"], 0.9)]
    return spark.createDataFrame(rows, "form string, lemma string, pos string, grammemes array<string>, score double")


def test_words_after_a_comma(spark):
    rows = [("Так, Любая вещь", 5, "Любая", "ADJF", []), ("Так, Иванов", 5, "Иванов", "NOUN", ["Surn"]), ("Так Любая", 4, "Любая", "ADJF", []), ("Так, Его", 5, "Его", "NPRO", []), ("Так, ЛЮБАЯ", 5, "ЛЮБАЯ", "ADJF", []), ("Так, Синий", 5, "Синий", "ADJF", ["Surn"])]
    df = spark.createDataFrame(rows, "t string, s int, w string, p string, g array<string>")
    assert [r[0] for r in df.select(P.after_comma_word(F.col("t"), F.col("s"), F.col("w"), F.col("p"), F.col("g"))).collect()] == [True, False, False, False, False, False]
    pairs = spark.createDataFrame([("Слово", "слово"), ("слово", "слово"), ("СЛово", "сЛово"), ("Слово", "слова")], "a string, b string")
    assert [r[0] for r in pairs.select(P.lowered(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_title_neighbours(spark):
    words = [("Вот", " "), ("Алые", " "), ("Паруса", ", "), ("Море", " "), ("и", " "), ("Дом", "")]
    df = spark.createDataFrame([(1, k, w, g) for k, (w, g) in enumerate(words)], "s int, word_no int, word string, gap string")
    got = {r["word"]: r["title_like"] for r in P.title_like(df, ["s"]).collect()}
    assert got == {"Вот": True, "Алые": True, "Паруса": True, "Море": False, "и": True, "Дом": False}


def test_case_policies_as_data(spark):
    ddl = "kind string, word string, body string, in_quotes boolean, fits boolean, after_comma boolean, title_like boolean, p double, verdict string"
    rows = [("mid-down", "Слово", "x.", False, True, False, False, 0.9, "exact"), ("mid-down", "Слово", "x.", True, True, False, False, 0.9, "false"), ("mid-down", "Любая", "x.", False, False, True, True, None, "exact"),
            ("mid-up", "слово", "x.", False, True, False, False, 0.4, "false"), ("start-up", "слово", "x. ", False, False, False, False, 0.7, "exact"), ("start-up", "слово", "x", False, False, False, False, 0.7, "false"), ("mid-down", "Ab2", "x.", False, True, False, False, 0.9, "false")]
    df = spark.createDataFrame(rows, ddl)
    variants = {"plain": {}, "quotes": {"quote_guard": False}, "comma": {"after_comma": True}, "comma, title": {"after_comma": True, "title_guard": True}, "only": {"after_comma_only": True}, "up": {"mid_up": True, "start_up": True}, "sure": {"mid_up": True, "confirm": 0.5}}
    got = {r["variant"]: (r["n"], r["n_right"], r["n_false"]) for r in P.case_variants(df, variants).collect()}
    assert got == {"plain": (1, 1, 0), "quotes": (2, 1, 1), "comma": (2, 2, 0), "comma, title": (1, 1, 0), "only": (1, 1, 0), "up": (3, 2, 1), "sure": (1, 1, 0)}
    with pytest.raises(ValueError):
        P.accepted_case({"other": 1})


def test_form_labels(spark, lexicon):
    pairs = spark.createDataFrame([("дом", "домам"), ("Дом", "дома"), ("дом", "дома"), ("дом", "дом"), ("дом", "идёт"), ("x", "y")], "a string, b string")
    got = {(r["a"], r["b"]): r["label"] for r in P.form_edits(pairs, lexicon, "a", "b").collect()}
    assert got == {("дом", "домам"): "case:datv|number:plur", ("Дом", "дома"): None, ("дом", "дома"): "case:gent", ("дом", "дом"): None, ("дом", "идёт"): None, ("x", "y"): None}


def test_same_forms(spark):
    lemmas = F.create_map(*[x for w, ls in (("дом", ["дом"]), ("дома", ["дом"]), ("идёт", ["идти"]), ("шёл", ["идти"])) for x in (F.lit(w), F.array(*[F.lit(y) for y in ls]))])
    rows = [("Дом, идёт", "Дома, шёл"), ("Дом идёт", "дома шёл"), ("дом идёт", "дома, шёл"), ("дом", "дом идёт"), ("дом", "шёл"), ("", ""), ("дом x", "дома x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(P.same_forms(F.col("a"), F.col("b"), lemmas)).collect()] == [True, False, False, False, False, False, False]


def test_commas_and_pairs(spark):
    df = spark.createDataFrame([(9, "Он", "и", "VERB", "CONJ"), (3, "При", "x", None, None), (8, "При", "x", None, None), (9, "x", "идёт", "NOUN", "VERB")], "i int, f string, n string, p string, q string")
    assert [r[0] for r in df.select(P.spurious_comma(F.col("i"), F.col("f"), F.col("n"), F.col("p"), F.col("q"))).collect()] == [True, True, False, True]
    words = spark.createDataFrame([(d, k, w) for d, t in enumerate(["Так же как", "то же дело", "в доме"]) for k, w in enumerate(t.split())], "d int, word_no int, word string")
    assert sorted((r["d"], r["apart"]) for r in P.ambiguous_pairs(words, ["d"]).collect()) == [(0, True), (1, False)]
    groups = spark.createDataFrame([("NOUN",), ("PREP",), (None,)], "p string")
    assert [r[0] for r in groups.select(P.previous_group(F.col("p"))).collect()] == ["NOUN", "rest", "rest"]


def test_rewriter_votes(spark):
    edits = spark.createDataFrame([(1, "typo", 0, 5, "слвоо", "слово"), (1, "ending", 10, 14, "дома", "дому"), (1, "ending", 20, 24, "дома", "дому"), (1, "comma_del", 30, 31, ",", ""), (1, "other", 40, 41, "a", "b")], "s int, class string, start int, end int, before string, after string")
    seen = spark.createDataFrame([(1, "check", "MODEL_FORM", 13, 14, "у"), (1, "error", "MODEL_FORM", 23, 24, "у"), (1, "candidate", "MODEL_COMMA_DEL", 30, 31, "")], "s int, level string, rule string, start int, end int, fix string")
    out = P.rewriter_findings(edits, {"typo": "check"}, seen, ["s"], {"ending": ("MODEL_FORM", "check"), "comma_del": ("MODEL_COMMA_DEL", "candidate")}).collect()
    assert sorted((r["start"], r["end"], r["fix"], r["level"], r["rule"]) for r in out) == [(2, 4, "ов", "check", "REWRITE_TYPO"), (13, 14, "у", "error", "REWRITE_ENDING"), (30, 31, "", "error", "REWRITE_COMMA_DEL")]


def test_mixes_and_heads(spark):
    a = spark.createDataFrame([(1, ["x", "y"], [False, False]), (2, ["x"], [True])], "s int, words array<string>, commas array<boolean>")
    b = spark.createDataFrame([(1, ["x", "z"], [True, False]), (2, ["x", "y"], [False, False])], "s int, words array<string>, commas array<boolean>")
    assert sorted((r["s"], r["text"], r["agreed"]) for r in P.mixed_systems(a, b, ["s"]).collect()) == [(1, "x, y", True), (2, "x,", False)]
    p = spark.createDataFrame([(1, 0, "a", 0.95), (1, 1, "b", 0.7), (1, 2, "c", 0.1), (1, 3, "d", 0.99)], "s int, word_no int, fix string, p double")
    bad = spark.createDataFrame([(1, 3)], "s int, word_no int")
    assert sorted((r["fix"], r["level"]) for r in P.form_findings(p, bad, ["s"], 0.9, 0.5).collect()) == [("a", "error"), ("b", "check")]
    m = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.4), (2, "a", 0.8)], "s int, model string, p double")
    assert [(r["s"], r["p"]) for r in P.earlier_passes(m, ["s"], "min", ["a", "b"]).collect()] == [(1, 0.4)]
    e = spark.createDataFrame([(1, [], [","]), (1, ["А"], ["а"])], "s int, before array<string>, after array<string>")
    assert {(r["feature"], r["value"]): r["n"] for r in P.edit_features(e, ["s"]).collect()} == {("action", "insert"): 1, ("action", "replace"): 1, ("size", "1"): 2, ("case_only", "false"): 1, ("case_only", "true"): 1}
    s = spark.createDataFrame([(1, "t"), (2, "u")], "s int, t string")
    c = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "c", "d"), (2, 0, "e", None)], "s int, word_no int, word string, wrong string")
    out = P.grammar_examples(s, c, ["s"], "seed").collect()
    assert [r["s"] for r in out] == [1] and out[0]["half"] in (1, 2)
