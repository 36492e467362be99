import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import divergence, queries
from tests.compare import assert_same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=10, top=10):
    """The definition, group by group, in whole numbers."""
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(divergence.TERM, (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        found[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in found[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        value = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(value(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-value(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:limit], 1)}
    return out


@pytest.mark.parametrize("block, chunk", [(3, 4), (1, 1000), (32, 4096)])
def test_tiles_against_the_definition(spark, block, chunk):
    rng = random.Random(block)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "naïve", "ZZ", "日本"]
    docs = [(rng.choice(["x", "x", "y", None]), rng.choice(["a", "a", "a", "b", "c", "d", "é", "Z", None, "e", "f"]), " ".join(rng.choice(words[: rng.randint(1, 24)]) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    docs += [("x", "none", None), ("x", "empty", ""), ("z", "p", "few words"), ("z", "q", None), ("z", "r", "x" * 5000), ("lone", "s", "a b")] + [("x", "a", "hot hot hot")] * 40
    df = spark.createDataFrame(docs, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS block", "3 AS n")
    rows = divergence.divergence(df, block=block, chunk=chunk).collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == plain(docs)


def test_no_documents(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    n = 9_000_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (3 * n + 14) and row["none"] is None


def test_query_against_its_twin(spark, data, duck):
    got = divergence.query_divergence(spark, data).toPandas()
    assert_same(got, duck.execute(queries.ORACLE_SQL["op13_tiled_source_divergence"]).df())


def test_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 3)
    texts = ["one Two, three-two é\nx " * 9 + "one", "", "1234567890" * 3, "unbroken" * 9, "a b c d e f g h"]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 5), pa.array(list("ababa")), pa.array(texts)], ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in divergence._counted(iter([batch, batch])):
        for row in out.to_pylist():
            n[row["source"], row["term"]] += row["n"]
            docs[row["source"], row["term"]] += row["docs"]
    expected, found = Counter(), Counter()
    for source, text in zip("ababa", texts, strict=True):
        terms = re.findall(divergence.TERM, text.translate(LOWER))
        expected.update({(source, t): 2 * k for t, k in Counter(terms).items()})
        found.update({(source, t): 2 for t in set(terms)})
    assert n == expected and docs == found
