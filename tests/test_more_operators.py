import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import edits, morphology, review
from corpuslab.operators.diff import TOKEN
from corpuslab.sources import patching, readers
from tests.test_sources import DOCX, ODT, package


def split(s):
    return [t for t in TOKEN.findall(s) if not t.isspace()]


def column(spark, c, ddl, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), ddl).select(c.alias("x")).collect()]


def test_admissible(spark):
    c = edits.admissible(F.col("b"), F.col("a"), F.col("s"), F.col("e"), F.col("l"))
    rows = [(["cat"], ["cats"], False, False, False), (["x", "y"], ["xy"], False, False, False), (["A4B"], ["A5"], False, False, False), (["q"], ['"', "q", '"'], False, False, False), (["."], [";"], False, True, False), (["one"], ["One"], True, False, True), (["..."], ["…"], False, False, False)]
    assert column(spark, c, "b array<string>, a array<string>, s boolean, e boolean, l boolean", *rows) == [True, False, False, False, False, False, False]


def test_edit_classes_and_policies(spark):
    rows = [([], [","], False, False, "comma_add"), ([","], [], False, False, "comma_del"), (["note", "book"], ["notebook"], True, True, "join"), (["hause"], ["house"], False, True, "typo"), (["wolf"], ["wolves"], True, True, "form"), (["cat"], ["dog"], True, True, "other")]
    df = spark.createDataFrame(rows, "b array<string>, a array<string>, x boolean, y boolean, want string").withColumn("class", edits.edit_class(F.col("b"), F.col("a"), F.col("x"), F.col("y")))
    assert all(r["class"] == r["want"] for r in df.collect())
    assert edits.by_policy(df, "commas").count() == 2 and edits.by_policy(df, "all").count() == 6
    with pytest.raises(ValueError):
        edits.by_policy(df, "none")


def test_levels_places_and_finish(spark):
    assert column(spark, edits.visible(F.col("l"), F.col("s")), "l string, s boolean", ("error", False), ("strict", True), ("strict", False), ("candidate", True)) == ["error", "check", None, None]
    assert column(spark, edits.in_quotes(F.col("t"), F.col("p")), "t string, p int", ("a «b c» d", 5), ("a «b c» d", 8), ('x "y z', 4)) == [True, False, True]
    assert column(spark, edits.at_sentence_start(F.col("t"), F.col("p")), "t string, p int", ("2.1) «Word", 6), ("One word", 4)) == [True, False]
    assert column(spark, edits.finished(F.col("a"), F.col("b")), "a string, b string", ("End;", "end."), ("№ 5 here", "N 5 here!")) == ["end;", "№ 5 here"]
    assert column(spark, edits.author_commas(F.col("t")), "t string", ("One, two three,",)) == [[("One", True), ("two", False), ("three", True)]]


def test_pairs_are_split_only_if_both_sides_agree(spark):
    a, b = "First one here. Second one.", "First one, here. Second one."
    df = spark.createDataFrame([(1, a, b), (2, a, "All in one")], "id int, src string, gold string")
    rows = edits.split_pairs(df, "src", "gold", longest=10).collect()
    assert [tuple(r)[1:] for r in rows if r["id"] == 1] == [("First one here.", "First one, here."), ("Second one.", "Second one.")]
    assert [tuple(r)[1:] for r in rows if r["id"] == 2] == [(a, "All in one")]


def test_labels_restore_the_gold(spark):
    rng = random.Random(5)
    words = ["wolf", "cat", "two-part", "Ёж", "5"]
    kept = 0
    for _ in range(300):
        src = "".join(rng.choice(words) + rng.choice([" ", ", "]) for _ in range(8)).strip(" ,") + "."
        gold = " ".join(t.rstrip(",") + ("," if rng.random() < 0.3 and not t.endswith(".") else "") if rng.random() < 0.9 else rng.choice(words) for t in src.split())
        got = edits.word_labels(src, gold)
        if got["reason"] == "kept":
            kept += 1
            assert edits.relabelled(split(src), got["comma"], got["form"]) == split(gold)
    assert kept > 50
    df = spark.createDataFrame([("one two.", "one, two."), ("one two.", "one more two."), (None, None)], "src string, gold string")
    rows = edits.labelled(df, "src", "gold").collect()
    assert [(r["comma"], r["reason"]) for r in rows] == [(["ADD", "KEEP"], "kept"), (None, "words"), ([], "kept")]


def test_only_allowed_edits_are_kept(spark):
    df = spark.createDataFrame([("We saw the hause and left.", "We saw, the house, and Left!")], "src string, out string")
    assert edits.kept_classes(df, "src", "out", ["comma"], "x").first()["x"] in ("We saw, the hause, and left.", "We saw, the hause and left.")
    assert edits.kept_classes(df, "src", "out", [], "x").first()["x"] == df.first()["src"]
    both = edits.kept_classes(spark.createDataFrame([("a note book here", "a notebook here")], "src string, out string"), "src", "out", ["join"], "x")
    assert both.first()["x"] == "a notebook here"


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("дом", "дом", "NOUN", ["nomn", "sing"], 0.9), ("дома", "дом", "NOUN", ["gent", "sing"], 0.8), ("дому", "дом", "NOUN", ["datv", "sing"], 0.9), ("дому", "дом", "NOUN", ["loc2", "sing"], 0.1), ("большого", "большой", "ADJF", ["gent", "sing"], 0.9), ("большому", "большой", "ADJF", ["datv", "sing"], 0.9), ("новый", "новый", "ADJF", ["nomn", "sing"], 0.9), ("неновый", "неновый", "ADJF", ["nomn", "sing"], 0.9)]
    return spark.createDataFrame(rows, "form string, lemma string, pos string, grammemes array<string>, score double")


def rows_of(spark, *texts):
    return spark.createDataFrame([(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(t.split())], "doc_id int, word_no int, word string")


def test_morphology(spark, lexicon):
    words = rows_of(spark, "для дому", "для дома", "большого дому", "Большому дому", "к дому", "не новый x 5")
    assert [(r["doc_id"], r["next"]) for r in morphology.preposition_case(words, lexicon, ["doc_id"]).collect()] == [(0, "дому")]
    assert [r["doc_id"] for r in morphology.adjective_noun(words, lexicon, ["doc_id"]).collect()] == [2]
    assert [r["fix"] for r in morphology.not_apart(words, lexicon, ["doc_id"]).collect()] == ["неновый"]
    pos = {r["word"]: r["pos"] for r in morphology.coarse_pos(words, lexicon).collect()}
    assert (pos["дому"], pos["x"], pos["5"], pos["к"]) == ("NOUN", "LATIN", "NUM", "OTHER")


def test_lemmas_and_inflection(spark, lexicon):
    pairs = spark.createDataFrame([("дома", "дому"), ("дома", "новый"), ("zzz", "дом")], "a string, b string")
    assert {(r["a"], r["b"]): r["same_lemma"] for r in morphology.same_lemma(pairs, lexicon, "a", "b").collect()} == {("дома", "дому"): True, ("дома", "новый"): False, ("zzz", "дом"): False}
    change = {(r["a"], r["b"]): (r["added"], r["removed"]) for r in morphology.changed_grammemes(pairs, lexicon, "a", "b").collect()}
    assert change["дома", "дому"] == (["datv"], ["gent"]) and change["zzz", "дом"] == (None, None)
    words = spark.createDataFrame([("Дом", "case:gent|number:sing"), ("дома", "case:ablt")], "word string, label string")
    assert {r["word"]: r["inflected"] for r in morphology.inflected(words, lexicon).collect()} == {"Дом": "Дома", "дома": None}


MARKS = "doc_id int, paragraph int, start int, level string, word string, fix string, status string"


def marks(spark):
    return spark.createDataFrame([(1, 0, 2, "error", "Foo", "bar", "open"), (1, 0, 9, "check", "foo", None, "open"), (1, 1, 0, "error", "x", None, "open"), (1, 2, 0, "error", "y", "z", "rejected")], MARKS)


def test_review_state(spark):
    m = marks(spark)
    assert tuple(review.counts(m, []).first()) == (2, 1, 0, 1)
    assert [r["status"] for r in review.accept_errors(m).orderBy("paragraph", "start").collect()] == ["accepted", "open", "open", "rejected"]
    own = spark.createDataFrame([("FOO",)], "word string")
    assert review.dismiss_words(m, own).where("status = 'rejected'").count() == 3
    near = {(r["paragraph"], r["start"]): (tuple(r["next_open"]), tuple(r["previous_open"])) for r in review.neighbours(m, ["doc_id"], ["paragraph", "start"]).collect()}
    assert near[1, 0] == ((0, 2), (0, 9)) and near[0, 2] == ((0, 9), (1, 0)) and near[2, 0] == ((0, 2), (1, 0))
    assert review.invalidate(m, spark.createDataFrame([(1, 0)], "doc_id int, paragraph int")).count() == 2


def test_lists_and_progress(spark):
    mine, new = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (["Alpha", "b"], ["ALPHA", " c ", ""]))
    assert sorted(r[0] for r in review.merged_dictionary(mine, new).collect()) == ["Alpha", "b", "c"]
    files = spark.createDataFrame([("a", 5.0), ("a", 9.0), ("b", 7.0), ("c", -1.0), ("d", 5e9)], "path string, opened_at double")
    assert [tuple(r) for r in review.recent(files).collect()] == [("a", 9.0), ("b", 7.0)]
    defaults, own = (spark.createDataFrame(rows, "name string, value string") for rows in ([("x", "1"), ("y", "2")], [("x", "7"), ("old", "0")]))
    assert sorted(map(tuple, review.with_defaults(own, defaults).collect())) == [("x", "7"), ("y", "2")]
    stages = spark.createDataFrame([("a", 10, 10, 1.0, 20.0), ("b", 10, 5, 2.0, 20.0)], "stage string, total int, done int, cost double, seconds double")
    rows = review.progress(stages, "stage").orderBy("stage").collect()
    assert [round(r["fraction"], 4) for r in rows] == [0.3333, 0.6667] and rows[0]["left"] == pytest.approx(20.0)
    moved = review.current_place(spark.createDataFrame([(1, 0, 2, "abcd"), (1, 5, 6, "")], "p int, start int, end int, fix string"), spark.createDataFrame([(1, 3), (1, 8), (2, 4)], "p int, pos int"), ["p"])
    assert sorted((r["p"], r["pos"], r["current"]) for r in moved.collect()) == [(1, 3, 5), (1, 8, 9), (2, 4, 4)]
    assert column(spark, review.corrected_name(F.col("p"), F.col("t")), "p string, t array<string>", ("a.txt", []), ("a.txt", ["a (corrected).txt"])) == ["a (corrected).txt", "a (corrected 2).txt"]


def test_patched_files(spark, tmp_path):
    fix = lambda p, a, b, t: {"paragraph": p, "start": a, "end": b, "text": t}
    for code, mark in (("utf-8", b""), ("cp1251", b""), ("utf-8", b"\xef\xbb\xbf")):
        content = mark + "один\r\nдва\n".encode(code)
        assert patching.patch_text(content, [fix(1, 0, 1, "Д"), fix(0, 4, 4, "!")]) == mark + "один!\r\nДва\n".encode(code)
    assert patching.patch_text("аб".encode("utf-16"), [fix(0, 0, 1, "")]) == "б".encode("utf-16")
    for name, content in (("a.docx", package("word/document.xml", DOCX)), ("b.odt", package("content.xml", ODT))):
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    todo = files.withColumn("r", F.array(F.struct(F.lit(0).alias("paragraph"), F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit("EST").alias("text"))))
    out = {r["path"][-6:]: bytes(r["x"]) for r in todo.select("path", patching.patched("path", "content", "r").alias("x")).collect()}
    assert [p["text"] for p in readers.office_paragraphs(out["a.docx"])] == ["TEST", "cell\t"]
    assert [p["text"] for p in readers.office_paragraphs(out["/b.odt"])] == ["TEST", "a  b\tc"]
    assert patching.patch_office(b"PK broken", []) is None


def test_spread_over_runs():
    fix = lambda a, b, t: {"start": a, "end": b, "text": t}
    assert patching.spread(["ab", "cd", "ef"], [fix(1, 5, "X")]) == ["aX", "", "f"]
    assert patching.spread(["ab", "cd"], [fix(2, 2, "-"), fix(4, 4, "!"), fix(0, 0, ">")]) == [">ab-", "cd!"]
    rng = random.Random(2)
    for _ in range(200):
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(4)]
        whole = "".join(pieces)
        a = rng.randint(0, len(whole))
        r = fix(a, rng.randint(a, len(whole)), rng.choice(["", "Z", "YY"]))
        assert "".join(patching.spread(pieces, [r])) == patching.spliced(whole, [r])
