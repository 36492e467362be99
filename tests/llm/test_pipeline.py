import re

import corpus_pipeline
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_dedup import brute as components


def test_each_stage_against_its_brute_force_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, data).persist()
        after = docs.collect()
        kept[name] = len(after)
        ids = sorted(r["doc_id"] for r in after)
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
            right = [(r["doc_id"] in set(ids)) == (labels[r["doc_id"]] == 1) for r in before if r["doc_id"] in labels]
            assert sum(right) >= 0.9 * len(right)
        elif name == "minhash_near_dedup":
            roots, _ = components([r["text"] for r in before], 5)
            assert ids == sorted(min(before[j]["doc_id"] for j, y in enumerate(roots) if y == x) for x in set(roots))
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
            hits = contaminated([r["text"] for r in before], items, 10)
            assert ids == sorted(r["doc_id"] for r, h in zip(before, hits, strict=True) if h[1] == 0)
        elif name == "source_mixing":
            size = lambda rows: sum(len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows)
            assert abs(size(after) - 1.5 * size(before)) < 0.05 * size(before)
            assert set(map(tuple, after)) <= set(map(tuple, before)) and max(ids.count(i) for i in set(ids)) <= 2
        else:
            assert sorted(map(repr, (tuple(r)[:-2] for r in after))) == sorted(map(repr, map(tuple, before)))
            sizes = [sum(r["shard"] == s for r in after) for s in range(8)]
            assert max(sizes) - min(sizes) <= 1
    assert kept["minhash_near_dedup"] < kept["quality_classifier"]


def test_stages_keep_extra_and_clashing_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("*", "1 as quality_score", "'b' as body", "2 as s", "3 as n_hit", "4 as key", "5 as node", "6 as shard").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert all((r["quality_score"], r["body"], r["s"], r["n_hit"], r["key"], r["node"], r["shard"]) == (1, "b", 2, 3, 4, 5, 6) for r in out.collect())


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0

