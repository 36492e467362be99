from pyspark.sql import functions as F

from corpuslab.functions import hashing, segment, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_match_key(spark):
    assert one(spark, text.match_key(F.col("t")), t="  Ёлка,  и —Wald! ") == "елка и wald"


def test_normal(spark):
    assert one(spark, text.normal(F.col("t")), t="«Да»  –  А. Б. Смит") == '"Да" - А.Б. Смит'


def test_words_join_hyphens(spark):
    assert one(spark, text.words(F.col("t")), t="e-mail, o'clock 3.5") == ["e-mail", "o", "clock", "3", "5"]


def test_list_marker(spark):
    assert one(spark, text.list_marker(F.col("t")), t="2.1) Two") == "2.1) "
    assert one(spark, text.list_marker(F.col("t")), t="Two") == ""


def test_bucket_is_the_whole_number(spark):
    import hashlib

    for key in ("a", "doc17", "ёж"):
        assert one(spark, hashing.md5_bucket(F.col("t")), t=key) == int(hashlib.md5(key.encode()).hexdigest(), 16) % 100


def test_uniform_is_inside(spark):
    rows = spark.range(500).select(hashing.md5_uniform("s", F.col("id")).alias("u"))
    low, high, mean = rows.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < low < 0.02 and 0.98 < high < 1 and abs(mean - 0.5) < 0.05


def cut(t):
    return [t[a:b] for a, b in segment.exact_spans(t)]


def test_abbreviations_and_initials_do_not_end_a_sentence():
    assert cut("See fig. 3 by A. Smith. It is new. ") == ["See fig. 3 by A. Smith.", "It is new."]
    assert cut("1. Scope of use. Next one.") == ["1. Scope of use.", "Next one."]


def test_no_split_before_lower_case_and_quotes_stay():
    assert cut("He said. and left. «Yes!» Then no.") == ["He said. and left.", "«Yes!»", "Then no."]


def test_blank_has_no_sentence():
    assert cut("  ") == [] and cut("") == []


def test_exact_sentences_keep_offsets(spark):
    df = spark.createDataFrame([(1, " Ab 😀 cd. Next!"), (2, None)], "id int, par string")
    rows = segment.exact_sentences(df, "par").orderBy("sent_no").collect()
    assert [(r["start"], r["end"], r["sentence"]) for r in rows] == [(1, 9, "Ab 😀 cd."), (10, 15, "Next!")]


def test_paragraph_kind(spark):
    kind = segment.paragraph_kind(F.col("t"), F.col("s"), F.col("m"))
    rows = spark.createDataFrame([(True, "Heading 1", ""), (False, "Heading 1", "1. "), (False, "", "- "), (False, "", "")], "t boolean, s string, m string")
    assert [r[0] for r in rows.select(kind).collect()] == ["table", "heading", "list", "body"]


def test_exact_sentences_of_many_kinds():
    cut = lambda t: [t[a:b] for a, b in segment.exact_spans(t)]
    assert cut("Письмо принял Б. В. Котов. Ответ дан 3 мая 2024 г. Минтруду.") == ["Письмо принял Б. В. Котов.", "Ответ дан 3 мая 2024 г. Минтруду."]
    assert cut("3.2. Сроки. Работа идёт! Так? Нет… Да.") == ["3.2. Сроки.", "Работа идёт!", "Так?", "Нет…", "Да."]
    assert cut("IV. Итог по разделу. а) Пункт остаётся.") == ["IV. Итог по разделу. а) Пункт остаётся."]
    assert cut("Сказано: «Хватит.» Все ушли (сразу.) Потом тихо") == ["Сказано: «Хватит.»", "Все ушли (сразу.)", "Потом тихо"]
    assert cut("Цена 7 тыс. руб. за шт. и т.п. Всё ясно.") == ["Цена 7 тыс. руб. за шт. и т.п. Всё ясно."]
    assert cut("Dr. Smith, e.g. Jones, came. Он рад.") == ["Dr. Smith, e.g. Jones, came.", "Он рад."]
    assert segment.exact_spans("  Да.   Нет. ") == [(2, 5), (8, 12)] and segment.exact_spans(" \t") == []
