"""Normalised pairs, word sites and what else evaluation asks of pairs, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import diff, edits, pairs
from corpuslab.sources import readers

LEXICON = [("дома", "дом"), ("дому", "дом"), ("слово", "слово"), ("слова", "слово"), ("вот", "вот"), ("так", "так"), ("потому", "потому")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([(f, lemma, "NOUN", 1.0) for f, lemma in LEXICON], "form string, lemma string, pos string, score double")


def applied(text, found):
    for e in sorted(found, key=lambda e: (e["start"], e["end"]), reverse=True):
        text = text[: e["start"]] + e["fix"] + text[e["end"] :]
    return text


def test_placed_edits_make_the_target():
    rng = random.Random(4)
    words = ["дом", "дома", "Слово", ",", ".", "-", "ёж", "еж", "«", "»", "12"]
    for _ in range(2000):
        a, b = ("".join(rng.choice(words) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randint(0, 9))) for _ in "ab")
        found = list(pairs.placed(a, b))
        got = applied(a, found)
        tokens = lambda s: [t.translate(str.maketrans("ёЁ–—−«»„“”", 'еЕ---"""""')) for t in diff.TOKEN.findall(s) if not t.isspace()]
        assert tokens(got) == tokens(b) or re.search(r"\w\S*\w|-", b), (a, b, got)  # glued tokens may tokenise otherwise
        assert all(x["end"] <= y["start"] for x, y in zip(found, found[1:], strict=False))


CASES = [  # source, target, normalised source, its target, classes, reason
    ("Вот слово так", "Вот, слово так", "Вот слово так", "Вот, слово так", ["comma"], None),
    ("Вот, слово так", "Вот слово так.", "Вот, слово так.", "Вот слово так.", ["comma"], None),
    ("Нет дома тут", "Нет дому тут", "Нет дома тут", "Нет дому тут", ["ending"], None),
    ("Нет даму тут", "Нет дому тут", "Нет даму тут", "Нет дому тут", ["spelling"], None),
    ("По тому вот", "Потому вот", "По тому вот", "Потому вот", ["join"], None),
    ("слово так", "Слово так", "Слово так", "Слово так", [], None),  # case is not taught
    ("Вот 12 слово", "Вот 13 слово", "Вот 13 слово", "Вот 13 слово", [], None),
    ("Вот ещё слово", "Вот еще слово", "Вот ещё слово", "Вот ещё слово", [], None),  # folded letters are equal
    ("Вот один два три четыре пять", "Вот слово", None, None, None, "rewrite_too_long"),
    ("12 13", "12, 13", None, None, None, "too_long"),
    (None, "Слово", None, None, None, "too_long"),
    ("а б в г д е ж з и к", "а, б, в, г, д, е, ж, з, и, к", None, None, None, "too_many_edits"),
    ("раз вот два вот три вот", "иное большое вот другое дело вот третья вещь вот", None, None, None, "too_much_rewriting"),
]


def test_normalised_pairs(spark, lexicon):
    df = spark.createDataFrame([(i, c[0], c[1], "x") for i, c in enumerate(CASES)], "id int, src string, gold string, source string").drop("source")
    rows = {r["id"]: r for r in pairs.normalised(df, ["id"], "src", "gold", lexicon, pairs.Limits(rewritten=5)).collect()}
    assert len(rows) == len(CASES)
    for i, (_, _, source, target, classes, reason) in enumerate(CASES):
        assert rows[i]["reason"] == reason, (i, rows[i])
        if reason is None:
            assert (rows[i]["source"], rows[i]["target"], rows[i]["classes"]) == (source, target, classes)


def test_normalised_pairs_keep_what_is_taught(spark, lexicon):
    """What is left between source and target is taught: normalising again changes nothing."""
    rng = random.Random(9)
    words = ["дома", "дому", "слово", "слова", "даму", "вот", "так", "Вот", "12", ","]
    rows = [(i, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in "ab")) for i in range(150)]
    once = pairs.normalised(spark.createDataFrame(rows, "id int, src string, gold string"), ["id"], "src", "gold", lexicon).where("reason is null").select("id", "source", "target", "classes")
    twice = pairs.normalised(once.select("id", F.col("source").alias("src"), F.col("target").alias("gold")), ["id"], "src", "gold", lexicon).collect()
    kept = {r["id"]: r for r in once.collect()}
    stable = [r for r in twice if r["reason"] is None and (r["source"], r["target"]) == (kept[r["id"]]["source"], kept[r["id"]]["target"])]
    assert len(kept) > 40 and len(stable) > 0.9 * len(kept)  # another alignment may class an edit otherwise


def test_word_sites(spark):
    texts = ["Вот слово, «так дома» и 12А слово — Иван, ABC конец", 'он "тут" там', "Текст // с. 12", None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {(r["id"], r["word"]): (r["comma"], r["form"]) for r in pairs.word_sites(df, ["id"], "text").collect()}
    assert rows[0, "Вот"] == (1, True) and rows[0, "слово"] == (1, True)  # the later one of two
    assert rows[0, "так"] == (0, False) and rows[0, "дома"] == (0, False) and rows[0, "и"] == (1, True)
    assert rows[0, "12А"] == (0, False) and rows[0, "Иван"] == (2, False) and rows[0, "ABC"] == (1, False) and rows[0, "конец"] == (0, True)
    assert rows[1, "тут"] == (0, False) and rows[1, "там"] == (0, True) and rows[2, "Текст"] == (0, False) and rows[5, "x"] == (0, True)


def test_findings_that_make_gold_edits(spark):
    texts = spark.createDataFrame([(1, "по тому вот как"), (2, "слово Дело и тут")], "id int, src string")
    gold = diff.edit_rows(spark.createDataFrame([(1, "по тому вот как", "потому вот, как"), (2, "слово Дело и тут", "слово дело и там")], "id int, a string, b string"), "a", "b")
    found = spark.createDataFrame([(1, 0, 7, "потому"), (1, 11, 11, ","), (2, 6, 10, "дело"), (2, 13, 16, "там"), (2, 6, 10, "тело")], "id int, start int, end int, fix string")
    got = pairs.reproduces(found, texts, gold, ["id"], "src").collect()
    assert sorted((r["id"], r["fix"]) for r in got) == [(1, "потому"), (2, "дело")]


def test_probabilities_of_a_head(spark):
    candidates = spark.createDataFrame([(1, 0, "LOWER"), (1, 1, "UPPER"), (2, 0, "LOWER")], "id int, word_no int, label string")
    head = spark.createDataFrame([(1, 0, {"LOWER": 0.7}), (1, 1, {"LOWER": 0.2})], "id int, word_no int, probabilities map<string,double>")
    assert sorted((r["id"], r["word_no"], r["p"]) for r in pairs.with_probability(candidates, head, ["id"]).collect() if r["p"]) == [(1, 0, 0.7)]


def test_profiles_and_their_distance(spark):
    a = spark.createDataFrame([("missing", "start", "x")] * 3 + [("missing", "tail", "x"), ("form", "tail", None)], "kind string, where string, only string")
    b = spark.createDataFrame([("missing", "start", "x"), ("missing", "head", "y")], "kind string, where string, only string")
    one, other = pairs.edit_profile(a, ["where", "only"]), pairs.edit_profile(b, ["where", "only"])
    assert {tuple(r) for r in one.collect()} == {("missing", "where", "start", 3), ("missing", "where", "tail", 1), ("missing", "only", "x", 4), ("form", "where", "tail", 1)}
    assert [tuple(r) for r in pairs.profile_distance(one, other).collect()] == [("missing", 0.5, 2)]
    assert [r["distance"] for r in pairs.profile_distance(one, one).where("kind = 'missing'").collect()] == [0.0]


def test_spelling_type(spark):
    rows = spark.createDataFrame([(["по", "тому"], ["потому"]), (["Дело"], ["дело"]), (["дело"], ["тело"]), ([], ["дело"]), (["дело"], ["дело"])], "before array<string>, after array<string>")
    assert [r[0] for r in rows.select(pairs.spelling_edit(F.col("before"), F.col("after"))).collect()] == [True, True, False, False, False]
    assert edits.POLICIES


# readers


def test_items_of_a_benchmark(spark, tmp_path):
    for name in ("dev2", "test2"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"src": f"{name} {k}", "gold": "g", "doc": "d", "more": 1}) for k in range(2)) + "\n\n")
    rows = readers.benchmark_items(spark, {n: str(tmp_path / f"{n}.jsonl") for n in ("dev2", "test2")}).collect()
    assert sorted((r["split"], r["src"], r["raw"], r["disputed"]) for r in rows) == [(n, f"{n} {k}", f"{n} {k}", []) for n in ("dev2", "test2") for k in range(2)]
    with pytest.raises(ValueError):
        readers.benchmark_items(spark, {})


def test_the_editable_form_of_a_document(spark):
    files = spark.createDataFrame([("a", "x/a.pdf", 1), ("a", "x/a.DOCX", 2), ("a", "x/b.docx", 3), ("b", "x/b.html", 4), ("c", "x/c.exe", 5)], "doc string, path string, n int")
    assert sorted(tuple(r) for r in readers.editable_first(files, "doc", "path").collect()) == [("a", "x/a.DOCX", 2), ("b", "x/b.html", 4)]


def test_the_size_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"12345")
    (tmp_path / "y.txt").write_bytes(b"123")
    assert tuple(readers.folder_size(spark, str(tmp_path)).first()) == (2, 8)
