"""Evaluation, cleaning, rules over a lexicon, ranks by ranges and streams over several files."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import cleaning as C
from corpuslab.functions import segment as S
from corpuslab.operators import edits, filters, morphology, review, rules, sampling, synth
from corpuslab.operators import evaluation as E
from corpuslab.plans import findings as plan_findings
from corpuslab.sources import readers
from corpuslab.streaming import events
from corpuslab.streaming import findings as stream


def test_verdicts_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.randrange(3), a, a + rng.choice([0, 1, 2]), rng.choice("xy")) for a in (rng.randrange(30) for _ in range(n))]
    gold, system, disputed = (sorted(set(make(n))) for n in (20, 40, 8))
    ddl = "doc_id int, i1 int, i2 int, after string"
    out = E.classified(*(spark.createDataFrame(x, ddl) for x in (system, gold, disputed)), ["doc_id"]).collect()

    def verdict(s):
        if s in gold:
            return "exact"
        if any(s[0] == g[0] and s[1] <= g[2] and g[1] <= s[2] for g in gold):
            return "place"
        held = lambda e: range(e[1], max(e[1] + 1, e[2]))
        return "disputed" if any(s[0] == r[0] and set(held(s)) & set(held(r)) for r in disputed) else "false"

    assert {tuple(r[:4]): r["verdict"] for r in out} == {s: verdict(s) for s in system}


def test_soft_labels(spark):
    rows = [(1, 1, "KEEP", 0.9), (1, 2, "A", 0.4), (1, 3, "B", 0.6), (2, 1, "A", 0.5), (2, 2, "A", 0.3), (2, 3, "A", 0.8)]
    df = spark.createDataFrame(rows, "k int, model int, label string, p double")
    got = {how: {r["k"]: (r["label"], r["p"]) for r in E.soft_label(df, ["k"], how).collect()} for how in E.SOFT}
    assert got == {"first": {1: ("KEEP", 0.9), 2: ("A", 0.5)}, "max": {1: ("B", 0.6), 2: ("A", 0.8)}, "agreed": {1: ("KEEP", 0.0), 2: ("A", 0.3)}}
    with pytest.raises(ValueError):
        E.soft_label(df, ["k"], "median")


def test_guard_subsets_against_brute_force(spark):
    rng = random.Random(5)
    rows = [tuple(rng.random() < 0.4 for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, r boolean")
    got = {r["guards"]: (r["n_kept"], r["n_right"]) for r in E.flag_grid(df, {k: F.col(k) for k in "abc"}, F.col("r")).collect()}
    for n in range(4):
        for on in combinations("abc", n):
            kept = [x for x in rows if not any(x["abc".index(k)] for k in on)]
            assert got["+".join(on)] == (len(kept), sum(x[3] for x in kept))


def test_votes_take_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "i int, fix string")
    b = spark.createDataFrame([(1, None), (2, "y"), (2, "y")], "i int, fix string")
    assert [r["i"] for r in E.voted(a, b, ["i", "fix"]).collect()] == [1]


def test_wiki_markup(spark):
    page = "== Head ==\n* [[Target|shown]] and [[plain]] '''bold'''<ref name='a'>note</ref> end\n{| class=x\n| cell\n|}\n{{a {{b}} c}}text [http://x.y label]\n\n"
    assert spark.createDataFrame([(page,)], "t string").select(C.wiki_lines(F.col("t"))).first()[0] == ["Head", "shown and plain bold end", "text label"]


def test_genres(spark):
    titles = ["Приказ № 5", "приказ о", "Письмо", "Письмо от 12.03.2001", "Доклад (Иванов)", "Роман", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    t = F.col("t")
    rows = df.select(C.titled(t, C.ACTS), C.titled(t, C.ADMIN), C.personal_title_ok(t)).collect()
    assert [tuple(r) for r in rows] == [(True, False, True), (True, False, True), (False, True, False), (False, True, True), (False, True, False), (False, False, True), (None, None, None)]
    texts = spark.createDataFrame([("Миръ и война",), ("объём",), ("#REDIRECT [[x]]",), ("Иванов И. // М., 2001",)], "t string")
    got = texts.select(C.old_orthography(t), C.is_redirect(t), C.bibliography(t)).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, False, False), (False, True, False), (False, False, True)]


def test_cyrillic_sentences(spark):
    df = spark.createDataFrame([(1, "Это первое. Второе предложение; Третье: «Четвёртое» слово. и пятое")], "doc_id int, text string")
    assert [r["sentence"] for r in S.sentences(df).collect()] == ["Это первое.", "Второе предложение;", "Третье:", "«Четвёртое» слово. и пятое"]
    assert [r["sentence"] for r in S.sentences(df, gap=S.STRICT_GAP).collect()] == ["Это первое.", "Второе предложение; Третье: «Четвёртое» слово. и пятое"]


def test_checkable_by_script(spark):
    df = spark.createDataFrame([("Это вполне обычное предложение здесь.",), ("This is a plain English sentence.",), ("Это слово very long English words here вот.",)], "s string")
    script = filters.checkable(F.col("s"), script="[А-Яа-яЁё]", foreign="[A-Za-z]")
    assert [r[0] for r in df.select(script).collect()] == [True, False, False]


def test_damaged_and_compound_words(spark):
    one = lambda *ws: spark.createDataFrame([(w,) for w in ws], "word string")
    known = one("программно", "аппаратных", "подконтрольными", "научно", "технический")
    assert {r[0] for r in C.damaged(one("программноаппаратных", "подконт-рольными", "научно-технический", "слово"), known).collect()} == {"программноаппаратных", "подконт-рольными"}
    assert [r[0] for r in C.compound_known(one("научно-технический", "научно-слово"), known).collect()] == ["научно-технический"]
    split = C.prefix_split(one("авианаучно", "научно", "авиатехнический"), spark.createDataFrame([("а",), ("авиа",)], "prefix string"), known).collect()
    assert {(r["word"], r["prefix"]) for r in split} == {("авианаучно", "авиа"), ("авиатехнический", "авиа")}


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a, b c", "слово 😀", "собакой", "собакам")], "t string, u string, x string, y string")
    row = df.select(C.gaps(F.col("t")).alias("g"), C.utf16_length(F.col("u")).alias("n"), C.trimmed(F.col("x"), F.col("y")).alias("e")).first()
    assert row["g"] == [", ", " "] and row["n"] == 8 and tuple(row["e"]) == (5, "ой", "ам")
    fixed = df.select(C.with_comma(F.lit(" "), F.lit(True)), C.with_comma(F.lit(", "), F.lit(False)), C.with_comma(F.lit(", "), F.lit(True)), C.errors_per_batch(F.lit(8), F.lit(0.01)), C.padded(F.array(F.lit(1)), F.lit(3), F.lit(0))).first()
    assert tuple(fixed) == (", ", " ", ", ", 1, [1, 0, 0])
    words = F.array(F.lit("abcdefghi"), F.lit("ab"), F.lit("abcd"))
    tokens = df.select(C.sub_tokens(words, 4).alias("s"), C.label_places(words, 4).alias("p")).first()
    assert [t["piece"] for t in tokens["s"]] == ["abcd", "efgh", "i", "ab", "abcd"] and tokens["p"] == [0, 3, 4]


@pytest.fixture(scope="module")
def parses(spark):
    rows = [("большой", "большой", "ADJF", ["nomn", "sing", "masc"], 0.9), ("большая", "большой", "ADJF", ["nomn", "sing", "femn"], 0.9), ("большие", "большой", "ADJF", ["nomn", "plur"], 0.9), ("дом", "дом", "NOUN", ["nomn", "sing", "masc"], 0.9),
            ("дома", "дом", "NOUN", ["nomn", "plur", "masc"], 0.5), ("сделана", "сделать", "PRTS", ["sing", "femn"], 0.9), ("странно", "странно", "ADVB", [], 0.9), ("странна", "странный", "ADJS", ["sing"], 0.9), ("сервер", "сервер", "NOUN", ["nomn", "sing", "masc"], 0.9), ("день", "день", "NOUN", ["nomn", "sing", "masc"], 0.9)]
    return spark.createDataFrame(rows, "form string, lemma string, pos string, grammemes array<string>, score double")


def rows_of(spark, *texts):
    return spark.createDataFrame([(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(t.split())], "doc_id int, word_no int, word string")


def test_rules_over_a_lexicon(spark, parses):
    words = rows_of(spark, "большой дом", "большая дом", "большие дом", "большие дома", "сделанна", "Денъ", "web сервер", "web дом")
    assert sorted(r["doc_id"] for r in morphology.agreement(words, parses, ["doc_id"]).collect()) == [1, 2]
    assert [(r["word"], r["fix"]) for r in rules.double_n(words, parses).collect()] == [("сделанна", "сделана")]
    assert [(r["word"], r["fix"]) for r in rules.hard_sign(words, parses).collect()] == [("Денъ", "День")]
    heads = spark.createDataFrame([("сервер",)], "lemma string")
    assert [r["fix"] for r in rules.latin_hyphen(words, parses, heads, ["doc_id"]).collect()] == ["web-сервер"]
    wrong = {r["word"]: r["wrong"] for r in morphology.other_form(rows_of(spark, "дом сервер x"), parses, "s").collect()}
    assert wrong == {"дом": "дома", "сервер": None, "x": None}
    assert sorted(r["word"] for r in morphology.all_declinable(rows_of(spark, "дом странно x"), parses).collect()) == ["дом"]


def test_rule_pack_with_guards(spark):
    texts = ["Так же он пришёл домой.", "Он так же рад.", "Он сделал так же.", "Сделано так же, как вчера.", "Кто то пришёл из за угла.", "Иванов кто то // М., 2001.", "локально-вычислительная сеть", "локально-вычислительной сети", "8 часового дня", "как либо иначе"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = sorted((r["id"], r["rule"], r["rank"], r["fix"]) for r in rules.guarded_findings(df, "s", rules.RUSSIAN).collect())
    assert got == [(0, "TAKZHE", 3, "Также"), (1, "TAKZHE", 2, "также"), (4, "DEFIS_PARTICLE", 3, "Кто-то"), (4, "IZ_ZA", 3, "из-за"), (6, "LOCAL_NET", 3, "локальная вычислительная"), (7, "LOCAL_NET", 3, "локальной вычислительной"), (8, "NUM_ADJ", 3, "8-часового"), (9, "DEFIS_PARTICLE", 3, "как-либо")]
    quoted = [rules.Rule("IZ_ZA", "error", r"(?iU)\b(из) (за)\b", "$1-$2", outside_quotes=True)]
    df = spark.createDataFrame([("из за «из за» x",)], "s string")
    assert [r["start"] for r in rules.guarded_findings(df, "s", quoted).collect()] == [0]


def test_edit_units_and_classes(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "c"]), (2, ["x"], ["y", "z"]), (3, ["Слово"], ["слово"])], "id int, before array<string>, after array<string>")
    assert sorted((r["id"], r["before"], r["after"]) for r in edits.units(df).collect()) == [(1, ["b"], ["c"]), (2, ["x"], ["y", "z"]), (3, ["Слово"], ["слово"])]
    assert [r["id"] for r in edits.case_edits(df).collect()] == [3]
    pairs = spark.createDataFrame([([","], [], False, True), (["не", "большой"], ["небольшой"], False, True), (["дома"], ["дому"], True, True), (["слвоо"], ["слово"], False, False), (["раз"], ["два"], False, True)], "b array<string>, a array<string>, s boolean, k boolean")
    assert [r[0] for r in pairs.select(edits.training_class(F.col("b"), F.col("a"), F.col("s"), F.col("k"))).collect()] == ["comma", "join", "ending", "spelling", None]


def test_undo_against_a_stack(spark):
    rng = random.Random(6)
    log = [(u, k, rng.random() < 0.45) for u in range(5) for k in range(60)]
    got = {(r["u"], r["k"]) for r in review.undone(spark.createDataFrame(log, "u int, k int, x boolean"), ["u"], "k", F.col("x")).collect()}
    stacks = {}
    for u, k, undo in log:
        stack = stacks.setdefault(u, [])
        if not undo:
            stack.append((u, k))
        elif stack:
            stack.pop()
    assert got == {e for s in stacks.values() for e in s}


def test_ranks_by_ranges(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else None, rng.randrange(10**6)) for _ in range(500)]
    got = sampling.ordered_rank(spark.createDataFrame(rows, "g string, id bigint"), ["g"], "id").collect()
    for g in ("hot", None):
        order = sorted({i for x, i in rows if x == g})
        assert all(r["rank"] == order.index(r["id"]) + 1 for r in got if r["g"] == g)
    tiles = spark.range(1, 12).select(sampling.tile(F.col("id"), F.lit(11), 4).alias("t"))
    assert [r["t"] for r in tiles.collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4]
    assert sampling.ordered_rank(spark.createDataFrame([], "g string, id bigint"), ["g"], "id").count() == 0


def test_examples_are_restorable(spark):
    df = spark.createDataFrame([(1, "One, two, three and four, five."), (2, "word")], "id int, t string")
    out = synth.examples(df, "t", "id", "s", drop=0.9).collect()
    assert [r["id"] for r in out] == [1] and synth.restore_commas(out[0]["corrupted"]["text"], out[0]["corrupted"]["comma"]) == df.first()["t"]


def test_numbered_files_stop_at_the_gap(spark, tmp_path):
    for k in (1, 2, 4):
        (tmp_path / f"batch{k}.jsonl").write_text('{"x": %d}\n' % k)
    assert sorted((r["batch"], r["x"]) for r in readers.numbered(spark, str(tmp_path), "batch{}.jsonl").collect()) == [(1, 1), (2, 2)]
    assert readers.numbered(spark, str(tmp_path), "none{}.jsonl") is None


def test_streams_over_a_folder_of_parts(spark, data, tmp_path):
    table = readers.table(spark, data, "events")
    table.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    rows = plan_findings.finding_columns(events.event_stream(spark, str(tmp_path)))
    got = events.drained(stream.upserted(rows), "update", stream.KEYS).toPandas()
    places = plan_findings.finding_columns(table).select(*stream.KEYS).distinct().count()
    assert len(got) == places and not got.duplicated(stream.KEYS).any()
    hourly = events.drained(events.hourly(events.event_stream(spark, str(tmp_path), files_per_trigger=2), "60 days"))
    assert hourly.agg(F.sum("n")).first()[0] == table.count()


def test_idle_places_are_forgotten():
    class State:
        hasTimedOut, exists, removed = True, True, False

        def remove(self):
            self.removed = True

    state = State()
    assert list(stream._update((1, 2, 3), iter(()), state)) == [] and state.removed
