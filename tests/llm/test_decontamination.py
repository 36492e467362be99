import random
import re

from corpuslab.llm.decontamination import find_contamination
from corpuslab.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same
from tests.llm.conftest import prose

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(texts, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else []:
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_against_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([1, 2, 3, 9, 10, 25, 60]))) for i in range(30)] + [(30, None), (31, " ?! "), (None, prose(rng, 20)), (5, prose(rng, 15)), (32, "the the the the the the the the the the the the")]
    texts = list(odd_texts)
    for _ in range(80):
        item = words(rng.choice(items)[1]) or ["x"]
        a = rng.randrange(len(item))
        texts.append(prose(rng, rng.randint(0, 30)) + " " + "-- ".join(item[a : a + rng.randint(1, 40)]).upper() + ". " + prose(rng, 5))
    texts.append("the " * 30)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(texts, items, 10)
    for block in (8 << 20, 200):
        rows = find_contamination(make_docs(texts), bench, block_bytes=block).collect()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == expected
        assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["hit_spans"]) for r in rows)


def test_empty_tables_and_clashing_names(spark, make_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["n_hit"] for r in find_contamination(make_docs(["a b"]), bench).collect()] == [0]
    assert find_contamination(make_docs([]), bench).count() == 0
    df = spark.createDataFrame([("q", 7, "t w o")], "items string, n_hit int, text string")
    row = find_contamination(df, bench, carry=["items", "n_hit", "text"]).first()
    assert (row["items"], row["n_hit"], row["text"], row["_n_hit"], row["_items"]) == ("q", 7, "t w o", 0, [])


def test_sql_twin(spark, data, duck):
    name = "op6_prefix_filter_decontamination"
    assert_same(QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_many_blocks_give_the_same_as_one(spark, make_docs):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(1, 30))) for i in range(60)]
    texts = [prose(rng, 20) + " " + rng.choice(items)[1] + " " + prose(rng, 5) for _ in range(50)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (find_contamination(make_docs(texts), bench, carry=["doc_id"], block_bytes=size).orderBy("doc_id").collect() for size in (1 << 20, 300))
    assert one == many and sum(len(t) for _, t in items) > 12 * 300
