"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from corpuslab import plans
from corpuslab.session import local_session

HEADLINE = [
    "vocab_min_count", "sentence_split", "checkable_sentences", "drop_reason_counts", "key_dup_groups", "benchmark_decontaminate_anti", "anti_join_cascade", "md5_bucket_split",
    "stratified_length_sample", "doc_frequency_terms", "glued_words_split", "typo_suggest", "double_word_rule", "running_comma_flag", "token_prefix_offsets", "feature_share",
    "interval_overlap_join", "apply_findings", "edit_score_full_outer", "threshold_grid_f05", "ensemble_combine", "bootstrap_interval", "html_paragraphs", "rule_pack_findings", "verdict_classes", "events_hourly_window", "pricing_rollup", "regional_revenue",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))
    spark = local_session("bench", cores)
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of the first query
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        seconds[name] = round(best, 3)
    sentences = plans.QUERIES["sentence_split"](spark, folder).count()
    rules = seconds["rule_pack_findings"]  # the whole pack with its guards
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "rule_sentences_per_sec": round(sentences / max(rules, 1e-9))}))


if __name__ == "__main__":
    sys.exit(main())
