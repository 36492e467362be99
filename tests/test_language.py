"""Language model, tag patterns and fragments against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import fragments, gains, ngrams, patterns
from corpuslab.session import written

RNG = random.Random(3)
UNITS = [[RNG.choice("abcde") for _ in range(RNG.randint(0, 12))] for _ in range(40)] + [[], ["a"], ["a", "a"]] * 3


def units(spark):
    return spark.createDataFrame([(i, u) for i, u in enumerate(UNITS)] + [(99, None)], "id int, w array<string>")


class Plain:
    """The model by its definition: counts of all n-grams, interpolated from the shortest context."""

    def __init__(self, order, discount):
        self.order, self.discount, self.c = order, discount, [Counter() for _ in range(order + 1)]
        for u in UNITS:
            p = ["<s>"] * (order - 1) + u + ["</s>"]
            for i in range(order - 1, len(p)) if u else ():
                for n in range(1, order + 1):
                    self.c[n][tuple(p[i - n + 1 : i + 1])] += 1

    def p(self, context, word):
        size, kinds = sum(self.c[1].values()), len(self.c[1])
        out = (self.c[1][(word,)] + 1) / (size + kinds + 1)
        for n in range(2, self.order + 1):
            h = tuple(context[len(context) - n + 1 :])
            seen = {g[-1]: c for g, c in self.c[n].items() if g[:-1] == h}
            if seen:
                out = (max(seen.get(word, 0) - self.discount, 0) + self.discount * len(seen) * out) / sum(seen.values())
        return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_and_entropy(spark, order):
    m, plain = ngrams.model(units(spark), "w", order, 0.6), Plain(order, 0.6)
    events = [(" ".join(RNG.choice(["<s>", "a", "b", "z"]) for _ in range(order - 1)), RNG.choice(["a", "e", "z", "</s>"])) for _ in range(60)]
    for r in ngrams.probabilities(spark.createDataFrame(events, "context string, word string"), m).collect():
        assert math.isclose(r["p"], plain.p(r["context"].split(), r["word"]), rel_tol=1e-12)
    words = ["a", "b", "c", "d", "e", "</s>"]
    assert math.isclose(sum(plain.p(["a"] * (order - 1), w) for w in words), 1, abs_tol=0.02)  # what is left is of unknown words
    (r,) = ngrams.perplexity(units(spark).withColumn("g", F.lit(1)), "w", m, ["g"]).collect()
    bits, n = 0.0, 0
    for u in UNITS:
        p = ["<s>"] * (order - 1) + u + ["</s>"]
        for i in range(order - 1, len(p)) if u else ():
            bits -= math.log2(plain.p(p[i - order + 1 : i], p[i]))
            n += 1
    assert r["n_tokens"] == n and math.isclose(r["bits"], bits / n, rel_tol=1e-9)


@pytest.mark.parametrize(("order", "slices", "frequent"), [(2, 1, 2), (3, 4, 3), (4, 2, 0)])
def test_entropy_in_slices(spark, order, slices, frequent, monkeypatch):
    kept = []
    monkeypatch.setattr(ngrams, "written", lambda df, name: kept.append(name) or written(df, name))
    rows = units(spark).withColumn("n", F.col("id") % 3)
    whole = {r["g"]: r for r in ngrams.perplexity(rows.withColumnRenamed("n", "g"), "w", ngrams.model(rows, "w", order, 0.6), ["g"]).collect()}
    got = {r["n"]: r for r in ngrams.entropy(rows, "w", ["n"], order, 0.6, slices, frequent).collect()}
    assert got.keys() == whole.keys() and kept.count("entropy-part") == slices
    assert all(got[k]["n_tokens"] == r["n_tokens"] and math.isclose(got[k]["bits"], r["bits"], rel_tol=1e-12) for k, r in whole.items())
    assert ngrams.entropy(rows.where("id < 0"), "w", ["n"], order).collect() == []


def test_form_gains_against_every_place(spark):
    order, plain = 3, Plain(3, 0.75)
    m = ngrams.model(units(spark), "w", order, 0.75)
    forms = {"a": ["b", "z"], "c": ["d"], "e": ["e"]}
    table = spark.createDataFrame([(w, a) for w, x in forms.items() for a in x] + [("a", "b")], "word string, alternative string")
    found = ngrams.places(units(spark), "w", order)
    got = {(tuple(r["before"]), r["word"], tuple(r["after"])): (r["best"], r["gain"]) for r in ngrams.form_gains(found, table, m).collect()}

    def score(row):
        return round(sum(math.log(plain.p(row[i : i + 2], row[i + 2])) for i in range(len(row) - 2)), 9)

    expected, places = {}, 0
    for u in UNITS:
        p = ["<s>", "<s>", *u, "</s>"]
        for i in range(2, len(p) - 1):
            places += 1
            others = [a for a in forms.get(p[i], []) if a != p[i]]
            if others:
                before, after = p[i - 2 : i], p[i + 1 : i + 3]
                scores = {a: score([*before, a, *after]) for a in others}
                best = min(scores, key=lambda a: (-scores[a], a))
                expected[tuple(before), p[i], tuple(after)] = best, scores[best] - score([*before, p[i], *after])
    assert found.count() == places and set(got) == set(expected)
    assert all(got[k][0] == expected[k][0] and math.isclose(got[k][1], expected[k][1], abs_tol=1e-7) for k in got)


@pytest.mark.parametrize(("slices", "cell", "large", "frequent", "side", "sent"), [(1, 1 << 16, 1 << 20, 1 << 16, 32, 1 << 20), (3, 20, 1 << 20, 0, 1, 1 << 20), (2, 50, 60, 3, 2, 0)])
def test_gain_counts_in_cells(spark, slices, cell, large, frequent, side, sent, monkeypatch):
    """Families that share cells or are cut into squares of them give the counts of all places, and tables go with their part."""
    kept, gone = [], []
    monkeypatch.setattr(gains, "written", lambda df, name: kept.append(name) or written(df, name))
    monkeypatch.setattr(gains, "dropped", lambda df: gone.append(df))
    monkeypatch.setattr(gains, "SIDE", side)
    monkeypatch.setattr(gains, "BROADCAST", sent)
    monkeypatch.setattr(gains, "TOKENS", 40)
    rows = units(spark).withColumn("g", F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 3))).drop("id")
    family = {"a": "1", "b": "1", "c": "2", "d": "2", "e": "3"}
    table = spark.createDataFrame([(x, y) for x in family for y in family if x != y and family[x] == family[y]], "word string, alternative string")
    found, m = ngrams.places(rows, "w", 3), ngrams.model(rows, "w", 3, 0.6)
    limits = {"n_any": -99.0, "n_better": 1e-6, "n_half": 0.5}
    expected = {}
    scored = {(tuple(r["before"]), r["word"], tuple(r["after"])): r["gain"] for r in ngrams.form_gains(found, table, m).collect()}
    for r in found.collect():
        if (key := (tuple(r["before"]), r["word"], tuple(r["after"]))) in scored:
            n = expected.setdefault(r["g"], [0] * 4)
            for i, x in enumerate([-math.inf, *limits.values()]):
                n[i] += scored[key] > x
    families = lambda words: words.select("word", F.create_map(*[F.lit(x) for p in family.items() for x in p])[F.col("word")].alias("family"))
    got = {r["g"]: [r["n_places"], *[r[c] for c in limits]] for r in gains.gain_counts(rows, "w", "g", families, limits, 0.6, slices, cell, large, frequent).collect()}
    assert got == expected and None in got and 0 < sum(x[3] for x in got.values()) < sum(x[0] for x in got.values())
    assert kept.count("gain-asked") == kept.count("gain-part") == slices and len(gone) == len(kept) - slices


def test_gain_counts_of_nothing(spark):
    none = lambda words: words.select("word", F.col("word").alias("family"))
    rows = units(spark).select(F.lit("g").alias("g"), "w")
    assert gains.gain_counts(rows, "w", "g", none, {"n": 0.0}).collect() == []
    assert gains.gain_counts(rows.where("g = 'x'"), "w", "g", none, {"n": 0.0}).collect() == []


def test_forms_of_a_lexicon_and_of_endings(spark):
    lexicon = spark.createDataFrame([("house", "house", "NOUN"), ("houses", "house", "NOUN"), ("house", "house", "VERB"), ("housed", "house", "VERB")], "form string, lemma string, pos string")
    assert {tuple(r) for r in ngrams.lexicon_forms(lexicon).collect()} == {("house", "houses"), ("houses", "house"), ("house", "housed"), ("housed", "house")}
    words = spark.createDataFrame([("walken",), ("walked",), ("talked",), ("walks",), ("be",)], "word string")
    assert {tuple(r) for r in ngrams.endings(words).collect()} == {("walken", "walked"), ("walked", "walken")}


# tag patterns


def walked(tags, i):
    """Context of word i by walking word by word."""
    t, n = tags[i], len(tags)
    if t in "NO":
        j = i - 1
        while j >= 0 and tags[j] in "AJFU" and i - j <= 5:
            j -= 1
        if j >= 0 and tags[j] == "R":
            return "after_preposition", i - j
        prev, prev2 = tags[i - 1 : i] if i else "", tags[i - 2 : i - 1] if i > 1 else ""
        if prev == "U":
            return "after_numeral", 1
        if prev and prev in "AJF":
            return "noun_after_adj", 1
        if prev == "N":
            return "noun_noun_chain", 1
        if prev and prev in "VS":
            return "verb_object", 1
        return ("verb_object", 2) if prev2 and prev2 in "VS" else ("other", 0)
    if t in "AF":
        for j in range(i + 1, min(n, i + 7)):
            if tags[j] == "N":
                return "adj_noun_agreement", j - i
            if tags[j] not in "AJFUCD":
                break
        for j in range(i - 1, max(-1, i - 8), -1):
            if tags[j] == "N":
                return "participle_after_noun", i - j
        return "adj_no_head_right", 0
    if t in "VSJ":
        for j in range(i - 1, max(-1, i - 9), -1):
            if tags[j] in "NO":
                return "predicate", i - j
        return "predicate", 0
    return "other", 0


def test_form_contexts_against_walking(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("NOAJFSUVIGDRCTLX" + "NAFR" * 3) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, "A" * 50 + "N", "R" + "A" * 5 + "N", "R" + "A" * 6 + "N"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tags string")
    rows = patterns.word_tags(df, "tags").select("id", "at", patterns.form_context(F.col("tag"), F.col("before"), F.col("after")).alias("c")).collect()
    assert len(rows) == sum(len(t or "") for t in texts)
    for r in rows:
        assert tuple(r["c"]) == walked(texts[r["id"]], r["at"]), (texts[r["id"]], r["at"])


def test_distance_classes(spark):
    df = spark.range(8).select(patterns.distance_class(F.col("id")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["0", "1", "2", "3-4", "3-4", "5+", "5+", "5+"]


def test_matches_with_parts(spark):
    df = spark.createDataFrame([(1, "RAANRN"), (2, None), (3, "NNN")], "id int, tags string")
    rows = patterns.matched(df, "tags", {"group": "R(?<mods>A*)(?<head>N)", "pair": "NN", "nothing": "X*"}).collect()
    plain = {(r["id"], r["pattern"], r["first"], r["last"], tuple(tuple(p) for p in r["parts"])) for r in rows}
    assert plain == {(1, "group", 0, 4, (("mods", 1, 3), ("head", 3, 4))), (1, "group", 4, 6, (("mods", 5, 5), ("head", 5, 6))), (3, "pair", 0, 2, ())}
    again = patterns.matched(df, "tags", {"pair": "NN"}, overlapping=True).collect()
    assert [(r["first"], r["last"]) for r in again] == [(0, 2), (1, 3)]


def test_tags_of_a_lexicon(spark):
    lexicon = spark.createDataFrame([("the", "the", "CONJ", ["x"], 1.0), ("дом", "дом", "NOUN", ["x"], 0.9), ("дом", "домить", "VERB", ["x"], 0.1)], "form string, lemma string, pos string, grammemes array<string>, score double")
    words = spark.createDataFrame([(1, 1, "дом"), (1, 0, "die"), (1, 2, "12"), (2, 0, "Дом")], "id int, word_no int, word string")
    assert {(r["id"], r["tags"]) for r in patterns.tag_strings(words, lexicon, ["id"]).collect()} == {(1, "LNU"), (2, "N")}


# fragments


@pytest.mark.parametrize("block", [1, 8 << 20])
def test_every_occurrence(spark, monkeypatch, block):
    monkeypatch.setattr(fragments, "BLOCK_BYTES", block)
    rng = random.Random(7)
    docs = [[rng.choice(["a", "b", "ab", "é", "😀"]) for _ in range(rng.randint(0, 40))] for _ in range(30)] + [None, [], ["a"] * 50]
    wanted = [["a"], ["a", "b"], ["a", "a"], ["ab"], ["é", "😀"], ["b", "a", "b"], ["a", "b"], [], ["a"] * 9]
    d = spark.createDataFrame(list(enumerate(docs)), "doc int, w array<string>").withColumn("first_name", F.lit("x"))
    f = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)] + [(50, None)], "fragment_no bigint, fragment array<string>")
    got = Counter((r["doc"], r["fragment_no"], r["first"], r["last"]) for r in fragments.occurrences(d, f, "w", "fragment").collect())
    expected = Counter((i, k, at, at + len(w)) for i, t in enumerate(docs) for k, w in enumerate(wanted) for at in range(len(t or [])) if w and t[at : at + len(w)] == w)
    assert got == expected
    assert fragments.occurrences(d, f.limit(0), "w", "fragment").count() == 0


def test_very_many_fragments(spark):
    text = re.findall(r"\w+", " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000)))
    d = spark.createDataFrame([(1, text)], "doc int, w array<string>")
    f = spark.range(100_000).select(F.col("id").alias("fragment_no"), F.array(F.concat(F.lit("w"), (F.col("id") % 1000).cast("string")), F.concat(F.lit("x"), F.floor(F.col("id") / 1000).cast("string"))).alias("fragment"))
    pairs = Counter(zip(text[::2], text[1::2], strict=True))
    assert fragments.occurrences(d, f, "w", "fragment").count() == sum(n for (w, x), n in pairs.items() if int(w[1:]) < 1000 and int(x[1:]) < 100)


def test_rules_against_errors_that_were_made(spark, tmp_path):
    """Each gold error and each finding is looked for anew, word by word."""
    from corpuslab.plans import language

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "Cc", "d1", "x", "abc12"]) for _ in range(rng.randint(1, 12))) + ".", "en", "s", 0) for i in range(200)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    units = language.units_with_errors(spark, str(tmp_path))
    made, gold = language.doubled(units, ["doc_id", "para_no", "sent_no"], 0.33, "double")
    bad = {r["doc_id"]: (r["bad"], r["sentence"]) for r in made.collect()}
    expected = Counter()
    for r in gold.collect():
        text, before = bad[r["doc_id"]]
        assert text[: r["start"]] + r["fix"] + text[r["end"] :] == before and text[r["start"] : r["end"]] == f"{r['fix']} {r['fix']}"
        hits = [m.span() for m in re.finditer(r"(?i)\b([^\W\d_]{2,}) \1\b", text)]
        exact = any(h == (r["start"], r["end"]) for h in hits)
        over = any(h[0] < r["end"] and r["start"] < h[1] for h in hits)
        expected["DOUBLE_WORD", "exact" if exact else "place" if over else "missed"] += 1
        expected["DOUBLE_WORD", "false"] += sum(not (h[0] < r["end"] and r["start"] < h[1]) for h in hits)
        expected["GLUED_DIGIT", "false"] += len(re.findall(r"\babc12\b", text))
    got = {(r["rule"], r["verdict"]): r["n"] for r in language.rules_against_gold(spark, str(tmp_path)).collect()}
    assert got == {k: n for k, n in expected.items() if n} and got["DOUBLE_WORD", "exact"] > 30
