"""The parser on tags, and findings over its arcs on labelled sentences."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import clauses, policies

W = [  # form, lemma, part of speech, grammemes
    "правила правило NOUN nomn,plur,neut", "правила правило NOUN gent,sing,neut", "сайта сайт NOUN gent,sing,masc", "вступают вступать VERB plur,3per", "вступает вступать VERB sing,3per", "в в PREP -", "силу сила NOUN accs,sing,femn",
    "новые новый ADJF nomn,plur", "отчёт отчёт NOUN nomn,sing,masc", "отчёт отчёт NOUN accs,sing,masc", "готова готовый ADJS sing,femn", "готов готовый ADJS sing,masc", "цели цель NOUN nomn,plur,femn", "и и CONJ -", "задачи задача NOUN nomn,plur,femn",
    "утверждены утвердить PRTS plur", "утверждена утвердить PRTS sing,femn", "я я NPRO nomn,sing,1per", "пишу писать VERB sing,1per", "пишет писать VERB sing,3per", "система система NOUN nomn,sing,femn", "созданная создать PRTF nomn,sing,femn",
    "центром центр NOUN ablt,sing,masc", "работает работать VERB sing,3per", "метро метро NOUN nomn,sing,neut,Fixd", "закрыта закрыть PRTS sing,femn", "три три NUMR nomn", "дома дом NOUN gent,sing,masc", "дома дом NOUN nomn,plur,masc", "стоит стоять VERB sing,3per",
    "без без PREP -", "доступа доступ NOUN gent,sing,masc", "доступу доступ NOUN datv,sing,masc", "большой большой ADJF nomn,sing,masc", "большого большой ADJF gent,sing,masc",
]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(f, lemma, pos, g.split(",") if g != "-" else [], 1.0 - k / 1000) for k, (f, lemma, pos, g) in enumerate(x.split() for x in W)]
    return spark.createDataFrame(rows, "form string, lemma string, pos string, grammemes array<string>, score double").cache()


def parsed(spark, lexicon, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    units = clauses.units(df, ["id"], "text", lexicon)
    return units, clauses.dependencies(units, ["id"])


LABELLED = [  # a sentence, and the verbs that do not agree
    ("Новые правила сайта вступают в силу", []), ("Новые правила сайта вступает в силу", ["вступает"]), ("Отчёт готова", ["готова"]), ("Отчёт готов", []), ("Цели и задачи утверждены", []),
    ("Система утверждены", ["утверждены"]), ("Я пишет", ["пишет"]), ("Я пишу", []), ("Метро закрыта", []), ("Три дома стоит", []), ("В силу вступает", []), ("Система, созданная центром, работает", []), ("Вступает отчёт", []), ("Вступают отчёт", ["Вступают"]),
]


def test_subject_and_verb(spark, lexicon):
    _, arcs = parsed(spark, lexicon, [t for t, _ in LABELLED])
    rows = clauses.subject_verb(arcs, lexicon, ["id"]).collect()
    got = {k: [r["word"] for r in rows if r["id"] == k] for k in range(len(LABELLED))}
    assert got == {k: wrong for k, (_, wrong) in enumerate(LABELLED)}
    assert clauses.subject_verb(arcs, lexicon, ["id"], ["отчёт", "система", "правила", "я"]).count() == 0


def test_commas_over_arcs(spark, lexicon):
    texts = ["Система созданная центром работает", "Система, созданная центром, работает", "Созданная система работает", "Система, работает", "Система работает", "Система созданная работает"]
    _, arcs = parsed(spark, lexicon, texts)
    assert [(r["id"], r["word_no"]) for r in clauses.participle_commas(arcs, ["id"]).collect()] == [(0, 0)]
    assert [(r["id"], r["word_no"]) for r in clauses.subject_commas(arcs, ["id"]).collect()] == [(3, 0)]


def test_commas_before_clauses(spark):
    texts = ["Мы знаем если он придёт", "Мы знаем, если он придёт", "Если он придёт", "Дом в котором он живёт", "Дом, в котором он живёт", "и если он", "Дом (который стоит)", "который"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0).alias("words"), clauses.gap_marks(F.col("text")).alias("gaps"))
    rows = clauses.subordinate_commas(df, ["id"], "words", "gaps", ["если"], ["котором", "который"], ["в"], ["и"]).collect()
    assert sorted((r["id"], r["word_no"]) for r in rows) == [(0, 1), (3, 0)]


def test_marks_of_examples(spark):
    texts = [("люди такие как он", "NXCO"), ("люди, такие как: он", "NXCO"), ("такие как он", "XCO"), ("идут такие как он", "VXCO")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(texts)], "id int, text string, tags string").select("id", "tags", F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0).alias("words"), clauses.gap_marks(F.col("text")).alias("gaps"))
    rows = clauses.example_marks(df, ["id"], "words", "tags", "gaps", "такие", "как").collect()
    assert sorted((r["id"], r["word_no"], r["rule"]) for r in rows) == [(0, 0, "COMMA_BEFORE_EXAMPLES"), (1, 2, "NO_COLON_AFTER_EXAMPLES")]


def reduced(tags, gaps):
    """The machine as string rewriting: after each symbol the first rule that fits, until none does."""
    text, out = [], []
    symbols = [s for i, t in enumerate(tags) for s in ([("V" if t in "SJ" else t, i)] + ([(gaps[i], -1)] if gaps[i] != " " else []))]
    for k, s in enumerate(symbols):
        text.append(s)
        following = symbols[k + 1][0] if k + 1 < len(symbols) else None
        again = True
        while again:
            again = False
            for rule in clauses.GRAMMAR:
                top = text[-len(rule.left) :]
                if "".join(x for x, _ in top) == rule.left and not (following and following in rule.unless) and not (len(text) > len(top) and text[-len(top) - 1][0] in rule.behind):
                    out.append((top[rule.dependent][1], top[rule.head][1], rule.relation))
                    text[-len(rule.left) :] = [(rule.result, top[rule.head][1])]
                    again = True
                    break
    return out


def test_machine_against_rewriting():
    rng = random.Random(8)
    for _ in range(3000):
        tags = "".join(rng.choice("NNnnAFUVSRCDOIX") for _ in range(rng.randint(0, 14)))
        gaps = "".join(rng.choice("     ,|") for _ in tags)
        got = clauses.arcs(tags, gaps)
        assert got == reduced(tags, gaps)
        assert len({d for d, _, _ in got}) == len(got) and all(d != h for d, h, _ in got)  # one head a word
    assert clauses.arcs("", "") == [] and len(clauses.arcs("AN" * 50_000, " " * 100_000)) == 50_000


def test_edits_that_break_grammar(spark, lexicon):
    units, _ = parsed(spark, lexicon, ["Отчёт без доступа", "Большой отчёт", "Отчёт без доступу"])
    edits = spark.createDataFrame([(0, 2, "доступу"), (0, 0, "сайта"), (1, 0, "большого"), (2, 2, "доступа")], "id int, word_no int, new string")
    bad = clauses.breaks_grammar(edits, units, lexicon, ["id"])
    assert sorted((r["id"], r["word_no"]) for r in bad.collect()) == [(0, 2), (1, 0)]
    predictions = edits.select("id", "word_no", F.col("new").alias("fix"), F.lit(0.95).alias("p"))
    kept = policies.form_findings(predictions, bad, ["id"], 0.9, 0.5).collect()
    assert sorted((r["id"], r["word_no"]) for r in kept) == [(0, 0), (2, 2)]
