import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import html_extraction as H
from corpuslab.llm import kernels as K
from corpuslab.llm import language_id as L
from corpuslab.llm import licenses as C
from corpuslab.llm import quality as Q
from tests.llm.conftest import prose

# language identification


def phrases(text, labelled):
    """Greedy longest matches by substring search; a symbol that does not occur is a phrase of its own."""
    n = k = 0
    while k < len(text):
        end = k + 1
        while end <= len(text) and text[k:end] in labelled:
            end += 1
        k = max(k + 1, end - 1)
        n += 1
    return n


def test_parse_against_brute_force():
    rng = random.Random(1)
    labelled = {"aa": prose(rng, 60).encode(), "bb": prose(rng, 60, "xa zo mi".split()).encode(), "cc": "éü ß".encode() * 9}
    parser = L.Parser(labelled)
    texts = [prose(rng, rng.randint(0, 150)) + rng.choice(["", "é qq", "ß"]) for _ in range(40)] + ["", "q", "qqq q", prose(rng, 900), labelled["aa"].decode() * 4, "ß" * 700, labelled["aa"].decode()[3:] + labelled["aa"].decode()]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = parser.phrases(data, offsets)
    assert got.tolist() == [[phrases(b, labelled[x]) for x in parser.languages] for b in raw]


CYCLE = "".join(random.Random(4).choice("abdeo ") for _ in range(97))


@pytest.mark.parametrize("text", ["a", "ab", CYCLE, "abcd", "q", "aq", "abcd" * 90 + "q"], ids=range(7))
def test_repetitive_text_is_parsed_in_linear_time(text):
    rng = random.Random(3)
    labelled = {"aa": prose(rng, 500).encode(), "bb": b"xa zo aaa aab", "cc": (b"abcd" * 40 + b" ") * 3}
    parser, text = L.Parser(labelled), text.encode()
    for length in (1, 300, 5000, 20_000):
        raw = (text * (length // len(text) + 1))[:length]
        got = parser.phrases(np.frombuffer(b"xa " + raw, np.uint8), np.array([0, 3, 3, 3 + length]))
        assert got.tolist() == [[phrases(b, labelled[x]) for x in parser.languages] for b in (b"xa ", b"", raw)]
    raw, start = np.frombuffer((text * (10_000_000 // len(text) + 1))[:10_000_000], np.uint8), time.time()
    parser.phrases(raw, np.array([0, len(raw)]))
    assert time.time() - start < 60  # some 4 s, of a machine that does nothing else


def test_suffix_automaton_knows_every_substring_and_no_other():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc") for _ in range(60))
    states = L.SuffixAutomaton(text).next

    def known(s):
        at = 0
        for c in s:
            if c not in states[at]:
                return False
            at = states[at][c]
        return True

    for _ in range(2000):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7)))
        assert known(s) == (s in text)


def test_language_query_on_held_out_documents(spark, data):
    rows = L.query_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_language_of_odd_texts(spark, make_docs, odd_texts):
    parser = L.Parser({"en": b"the word is the word", "fr": "le mot é".encode()})
    out = {r["doc_id"]: r for r in L.identify(make_docs([*odd_texts, "123 %%"]), parser, carry=["doc_id"]).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, len(odd_texts))] == ["und"] * 4
    assert out[3]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in out.values())
    assert L.identify(make_docs([]), parser).count() == 0
    assert L.identify(make_docs(["x"]), L.Parser({})).first()["lang_pred"] == "und"


# quality


def test_forward_pass_against_one_document_at_a_time():
    rng = np.random.default_rng(4)
    sizes = [1, 3, 7, 2]
    x, bounds = rng.normal(size=(sum(sizes), Q.FEATURES)), np.concatenate([[0], np.cumsum(sizes)])
    model = Q.Model(seed=3)
    model.mean, model.spread = rng.normal(size=Q.FEATURES), rng.random(Q.FEATURES) + 0.5
    got, p = model.forward(x, bounds)["y"], model.p
    for d in range(len(sizes)):
        hidden = [np.tanh((row - model.mean) / model.spread @ p["E"] + p["e"]) for row in x[bounds[d] : bounds[d + 1]]]
        weight = np.array([np.exp(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))) @ p["w"]) for h in hidden])
        pooled = sum(w * h for w, h in zip(weight / weight.sum(), hidden, strict=True))
        assert np.isclose(got[d], 1 / (1 + np.exp(-(pooled @ p["c"] + p["b"][0]))))


def numeric_gradient(model, x, bounds, label, weight, key, place):
    def loss():
        y = np.clip(model.forward(x, bounds)["y"], 1e-12, 1 - 1e-12)
        return float(-(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum())

    out = []
    for step in (1e-5, -1e-5):
        model.p[key][place] += step
        out.append(loss())
        model.p[key][place] -= step
    return (out[0] - out[1]) / 2e-5


def test_quality_gradient(monkeypatch):
    rng = np.random.default_rng(0)
    x, bounds, label = rng.normal(size=(12, Q.FEATURES)), np.array([0, 3, 4, 9, 12]), np.array([1, 0, 1, 0])
    model = Q.Model()
    weight = np.where(label == 1, 0.5 / 2, 0.5 / 2)
    slopes = {}
    # One step of plain descent shows the gradient: Adam's first step is rate * sign.
    for key, place in (("E", (3, 2)), ("V", (1, 1)), ("U", (0, 3)), ("w", (2,)), ("c", (5,)), ("e", (4,)), ("b", (0,))):
        fresh = Q.Model()
        fresh.mean, fresh.spread = x.mean(0), x.std(0) + 1e-3
        slopes[key] = numeric_gradient(fresh, x, bounds, label, weight, key, place)
        before = model.p[key][place]
        trained = Q.Model()
        trained.fit(x, bounds, label, steps=1, decay=0.0)
        moved = trained.p[key][place] - before
        assert abs(slopes[key]) < 1e-7 or np.sign(moved) == -np.sign(slopes[key])


def test_attention_sums_to_one_and_whole_texts_count(spark, make_docs, odd_texts):
    raw = [(t or "").encode() for t in odd_texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    x, bounds = Q.encode(K.Words(data, offsets, K.SPACE_WORDS))
    counts = [max(1, -(-len(re.findall("[^\x20\x09-\x0d]+", t or "")) // Q.PASSAGE)) for t in odd_texts]
    assert np.diff(bounds).tolist() == counts and np.isfinite(x).all()
    s = Q.Model().forward(x, bounds)
    assert np.allclose(np.add.reduceat(s["a"], bounds[:-1]), 1)
    alone = [Q.encode(K.Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), K.SPACE_WORDS))[0] for b in raw]
    assert np.allclose(np.concatenate(alone), x)


def test_quality_query_on_held_out_documents(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    rows = Q.query_quality(spark, data).join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert held and sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)


def test_quality_of_odd_texts_and_missing_labels(spark, make_docs, odd_texts):
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id bigint, quality int")
    model = Q.learn(make_docs(odd_texts), none)
    out = Q.classify(make_docs(odd_texts).withColumn("body", F.lit(1)), model).collect()
    assert len(out) == len(odd_texts) and all(0 <= r["score"] <= 1 and r["body"] == 1 for r in out)
    one = Q.learn(make_docs(odd_texts), spark.createDataFrame([(3, 0), (4, 0)], "doc_id bigint, quality int"))
    assert all(r["score"] < 0.5 for r in Q.classify(make_docs(odd_texts), one).collect())
    assert Q.classify(make_docs([]), model).count() == 0


# main text of pages


def test_messages_against_enumeration():
    rng = np.random.default_rng(3)
    parent, depth = np.array([-1, 0, 0, 1, 1, 2, -1, 6]), np.array([0, 1, 1, 2, 2, 2, 0, 1])
    unary, pair = rng.normal(size=(8, 2)), rng.normal(size=(8, 2, 2))
    node, edge, norm = H.messages(parent, depth, unary, pair)
    total, marginal, both = 0.0, np.zeros((8, 2)), np.zeros((8, 2, 2))
    for bits in range(256):
        y = [bits >> k & 1 for k in range(8)]
        p = np.exp(sum(unary[k, y[k]] for k in range(8)) + sum(pair[k, y[parent[k]], y[k]] for k in range(8) if parent[k] >= 0))
        total += p
        for k in range(8):
            marginal[k, y[k]] += p
            if parent[k] >= 0:
                both[k, y[parent[k]], y[k]] += p
    assert np.allclose(node, marginal / total) and np.allclose(edge, both / total) and np.isclose(norm, np.log(total))


def test_held_out_composed_pages():
    forest = H.Forest()
    for page in H.labelled_pages(120, seed=7):
        forest.add(page)
    content, label = H.trained().marginals(forest) >= 0.5, np.array(forest.label) == 1
    text = np.array([bool(t) for t in forest.text])
    assert (content == label)[text].mean() > 0.97


def test_pages_of_the_table(spark, data):
    import html as lib

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in H.query_main_text(spark, data).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", lib.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


_SENTENCES = "Ein Satz steht hier allein. Noch einer folgt ihm nach."
_P, _H, _NAV, _FOOT = f"<p>{_SENTENCES}</p>", "<h1>Titel</h1>", "<nav class=menu><ul><li><a href=/a>Start</a></li><li><a href=/b>News</a></li></ul></nav>", "<footer>&copy; 2020 Firma</footer>"
_LINKS = "<ul><li><a href=/x>Erster Punkt</a></li><li><a href=/y>Zweiter Punkt</a></li></ul>"
NAMELESS = {
    "five paragraphs in the body": (f"{_NAV}{_H}{_P * 5}{_FOOT}", ["Titel"] + [_SENTENCES] * 5),
    "three paragraphs in the body": (f"{_NAV}{_H}{_P * 3}{_FOOT}", ["Titel"] + [_SENTENCES] * 3),
    "one paragraph in the body": (f"{_NAV}{_H}{_P}{_FOOT}", ["Titel", _SENTENCES]),
    "five paragraphs in a div": (f"{_NAV}<div>{_H}{_P * 5}</div>{_FOOT}", ["Titel"] + [_SENTENCES] * 5),
    "three paragraphs in a div": (f"{_NAV}<div>{_H}{_P * 3}</div>{_FOOT}", ["Titel"] + [_SENTENCES] * 3),
    "a div without a title": (f"{_NAV}<div>{_P * 3}</div>{_FOOT}", [_SENTENCES] * 3),
    "a div with a name that says nothing": (f"{_NAV}<div id=c1>{_H}{_P * 5}</div>{_FOOT}", ["Titel"] + [_SENTENCES] * 5),
    "no other parts": (f"{_H}{_P * 3}", ["Titel"] + [_SENTENCES] * 3),
    "a title in a header": (f"{_NAV}<article><header>{_H}</header>{_P * 3}</article>{_FOOT}", ["Titel"] + [_SENTENCES] * 3),
    "linked items in an article": (f"{_NAV}<article>{_H}{_P * 2}{_LINKS}{_P}</article>{_FOOT}", ["Titel", _SENTENCES, _SENTENCES, "Erster Punkt", "Zweiter Punkt", _SENTENCES]),
    "columns of a table": (f"{_NAV}<table><tr><td>{_LINKS}</td><td>{_H}{_P * 4}</td></tr></table>{_FOOT}", ["Titel"] + [_SENTENCES] * 4),
    "an aside beside it": (f"{_NAV}{_H}{_P * 4}<aside><h3>Mehr</h3>{_LINKS}</aside>{_FOOT}", ["Titel"] + [_SENTENCES] * 4),
    "two sections": (f"{_NAV}<section>{_H}{_P}</section><section><h2>Zwei</h2>{_P * 2}</section>{_FOOT}", ["Titel", _SENTENCES, "Zwei", _SENTENCES, _SENTENCES]),
    "all parts in one div": (f"<div>{_NAV}{_H}{_P * 3}<div class=comments><p>Nett gesagt, danke sehr. Bis bald.</p></div>{_FOOT}</div>", ["Titel"] + [_SENTENCES] * 3),
}


@pytest.mark.parametrize("layout", NAMELESS)
def test_articles_without_a_telling_container(layout):
    inside, blocks = NAMELESS[layout]
    assert H.main_texts([f"<html><body>{inside}</body></html>"], H.trained()) == ["\n\n".join(blocks)]


def test_articles_of_composed_pages_are_kept():
    pages, shares = list(H.labelled_pages(1000, seed=11)), []
    for first in range(0, 1000, 200):
        forest = H.Forest()
        for page in pages[first : first + 200]:
            forest.add(page)
        content, label, text = H.trained().marginals(forest) >= 0.5, np.array(forest.label) == 1, np.array([len(t) for t in forest.text])
        page = np.searchsorted(forest.roots, np.arange(len(text)), side="right") - 1
        there, found = np.bincount(page, text * label), np.bincount(page, text * (label & content))
        shares += (found[there > 0] / there[there > 0]).tolist()
        assert found[there >= 100].min() > 0
    assert np.mean(np.array(shares) > 0.9) > 0.99 and np.mean(shares) > 0.995


BROKEN = [None, "", "plain words only", "<p>open <b>bold", "</div></p><p>x", "<!-- never closed <p>x</p>", "<script>var a='<p>'", "<p title='a>b'>quoted</p>", "<a href=\"x", "<p>&lt;b&gt; &amp; &#233;&nbsp;x</p>", "<div>" * 3000 + "deep" + "</div>" * 3000, "<ul><li>a<li>b</ul>", "<table><tr><td>a<td>b</table>", "<![CDATA[x<y]]>", "<", "<>"]


def test_nothing_but_forms_and_scripts_goes_by_name():
    body = "<p>Ein langer Absatz steht hier, mit Satz und Punkt. Noch ein Satz folgt ihm, damit er lang genug ist.</p>"
    page = f"<html><body><article class='post'>{body}<p>Die Formel <math><mi>x</mi><mo>=</mo><mn>2</mn></math> gilt immer, wie man sieht.</p><noscript><p>Auch ohne Skript bleibt dieser Satz im Artikel stehen.</p></noscript><script>var y = 1</script><select><option>ja</option></select>{body}</article></body></html>"
    (text,) = H.main_texts([page], H.trained())
    assert "x=2" in text and "ohne Skript" in text and "var y" not in text and "ja" not in text.split()


@pytest.mark.parametrize("depth", [70, 3000])
def test_text_after_deep_elements_stays(depth):
    body = "<p>Ein langer Absatz steht hier, mit Satz und Punkt. Noch ein Satz folgt ihm, damit er lang genug ist.</p>"
    page = f"<html><body><div class='post-content'>{body}{'<div>' * depth}{body}{'</div>' * depth}<p>Danach kommt der letzte Absatz, und er gehört dazu wie alle anderen auch.</p></div></body></html>"
    (text,) = H.main_texts([page], H.trained())
    assert "letzte Absatz" in text and text.count("langer Absatz") == 2


def test_broken_pages_never_fail(spark):
    df = spark.createDataFrame([(i, h, "u", "clash") for i, h in enumerate(BROKEN)], "page_id bigint, html string, url string, body string")
    out = {r["page_id"]: r for r in H.extract(df).collect()}
    assert len(out) == len(BROKEN) and out[0]["text"] == "" and out[1]["text"] == "" and out[0]["body"] == "clash"
    forest = H.Forest()
    forest.add(BROKEN[9])
    assert [t for t in forest.text if t] == ["<b> & é x"]
    forest = H.Forest()
    forest.add(BROKEN[10])
    assert [t for t in forest.text if t] == ["deep"] and max(forest.depth) <= H.MAX_DEPTH
    assert H.extract(df.limit(0)).count() == 0


def test_deep_elements_have_their_own_place():
    forest = H.Forest()
    forest.add("<main><article>" + "<div>" * 100 + '<div class="ad"><p>deep</p></div>' + "</div>" * 100 + "<p>late</p></article></main>")
    at = {t: k for k, t in enumerate(forest.text) if t}
    above = lambda k: [forest.tag[k]] + (above(forest.parent[k]) if forest.parent[k] >= 0 else [])
    names = lambda k: [H.TAGS[t] for t in above(k)]
    assert names(at["late"]) == ["#text", "p", "article", "main", "html"]
    assert names(at["deep"]) == ["#text", "p"] + ["div"] * 101 + ["article", "main", "html"]
    assert forest.bits[forest.parent[forest.parent[at["deep"]]]] == H._named("ad") != 0
    forest = H.Forest()
    forest.add("<div>" * 40_000 + "<ul>" + "<div>" * 10_000 + "<li>a</li>" * 1000 + "</div>" * 50_000)
    assert max(forest.level) == 50_003 and len(H.trained().marginals(forest)) == len(forest.parent)


# licences


@pytest.mark.parametrize("number", range(len(C.TEMPLATES)))
def test_every_template_is_found_in_prose(number):
    name, text = C.TEMPLATES[number]
    rng = random.Random(number)
    before, after = prose(rng, 30), prose(rng, 30)
    doc = f"{before}\n{text}\n{after}"
    found = scan_one(doc)
    assert name in {f[0] for f in found}
    best = max(found, key=lambda f: f[3])
    assert best[0] == name and best[3] == 1.0
    assert doc.encode()[best[1] : best[2]].decode().strip(" .\"") in text


def scan_one(doc):
    index = C.Index(C.TEMPLATES)
    raw = np.frombuffer(doc.encode(), np.uint8)
    words = K.Words(raw, np.array([0, len(raw)]), K.ALNUM_WORDS)
    places, entries = index.look_up(K.sequence_hash(words.hash, C.RUN))
    return [(index.names[t], int(words.start[a]), int(words.end[b - 1]), m / len(index.words[t])) for t, a, b, m in C.scan_row(words.hash, places, entries, index, 0.8)]


def test_altered_licence_is_still_found():
    words = C.TEMPLATES[2][1].split()
    for k in range(5, len(words), 17):
        words[k] = "changed"
    del words[10:12]
    found = scan_one("start " + " ".join(words) + " end")
    assert [f[0] for f in found] == ["MIT"] and 0.8 <= found[0][3] < 1


def test_short_licences_with_one_changed_word(spark, make_docs):
    docs = ["x Licensed under a CC BY 4.0 licence y", "x Licensed under the MIT licence y", "Released a under b the c MIT d License", "Licensed under CC BY 4.0. Licensed under CC BY 4.0."]
    rows = sorted(C.scan(make_docs(docs)).collect(), key=lambda r: r["doc_id"])
    assert [[x["license"] for x in r["licenses"]] for r in rows] == [["CC-BY-4.0"], ["MIT"], ["MIT"], ["CC-BY-4.0"] * 2]


@pytest.mark.parametrize("number", range(len(C.TEMPLATES)))
def test_one_word_edits_at_each_position(number):
    index = C.Index([C.TEMPLATES[number]])
    template, odd = index.words[0], np.uint64(1)
    none = np.zeros(0, np.int64)
    spare = len(template) - C.needed(0.8, len(template))
    around = lambda x: np.concatenate([np.full(20, odd), x, np.full(20, odd)])
    for k in range(len(template)):
        whole = C.scan_row(around(np.insert(template, k, odd)), none, none, index, 0.8)
        assert [f[3] for f in whole] == [len(template)]
        if spare:
            changed, gone = template.copy(), np.delete(template, k)
            changed[k] = odd
            assert [[f[3] for f in C.scan_row(around(x), none, none, index, 0.8)] for x in (changed, gone)] == [[len(template) - 1]] * 2
    for step in range(5):  # as many changed words as may be
        changed = template.copy()
        changed[(np.arange(spare) * 4 + step) % len(template)] = odd
        assert C.scan_row(around(changed), none, none, index, 0.8) or spare == 0


def test_winnowing_keeps_one_of_each_window():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 50, 200).astype(np.uint64)
    kept = set(C.winnow(h, 4).tolist())
    assert all(kept & set(range(k, k + 4)) for k in range(197))


def test_licence_query_against_text_search(spark, data):
    rows = C.query_licenses(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    lines = {"MIT": "Released under the MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    for r in rows:
        assert r["license_ids"] == ",".join(sorted(k for k, line in lines.items() if line in r["text"]))


def test_licences_of_odd_texts(spark, make_docs, odd_texts):
    rows = C.scan(make_docs(odd_texts)).collect()
    assert len(rows) == len(odd_texts) and not any(r["licenses"] for r in rows)
    assert C.scan(make_docs([])).count() == 0


def test_licences_against_full_alignment(spark):
    """A template is found exactly where the alignment over the whole text, without a band, has enough words."""
    rng = random.Random(8)
    template = "permission is granted free of charge to any person who obtains a copy of these files and notes"
    words = template.split()
    texts = []
    for _ in range(120):
        own = [w if rng.random() > 0.12 else rng.choice(["", "else", w + " more"]) for w in words] if rng.random() < 0.7 else rng.sample(words, len(words))
        texts.append(" ".join([prose(rng, rng.randint(0, 8)), *own, prose(rng, rng.randint(0, 8))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: r["licenses"] for r in C.scan(df, templates=[("X", template)]).collect()}
    need = C.needed(0.8, len(words))
    expected = {i: C.align(t.split(), words, 0, 10**6)[0] for i, t in enumerate(texts)}
    assert {i for i, spans in found.items() if spans} == {i for i, n in expected.items() if n >= need}
    assert all(max(s["matched"] for s in spans) == expected[i] for i, spans in found.items() if spans)
    assert 30 < sum(n >= need for n in expected.values()) < 110
