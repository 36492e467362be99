"""The queries of this subpackage, by the name under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import decontamination, divergence, embedding_dedup, html_extraction, language_id, licenses, mixing
from corpuslab.llm import near_dedup, quality, sharding, spelling, substring_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_attention_quality": quality.query_quality,
    "op2_tree_html": html_extraction.query_main_text,
    "op3_hypergeometric_sharding": sharding.query_shard,
    "op4_hyperminhash_near_dedup": near_dedup.query_near_dedup,
    "op5_cross_parsing_language": language_id.query_language,
    "op6_prefix_filter_decontamination": decontamination.query_decontaminate,
    "op7_pigeonhole_near_vectors": embedding_dedup.query_near_vectors,
    "op8_winnowed_licenses": licenses.query_licenses,
    "op9_pareto_mixing": mixing.query_mix,
    "op10_induced_sorting_repeats": substring_dedup.query_remove_repeats,
    "op11_symmetric_delete_variants": spelling.query_variants,
    "op12_batched_token_counts": token_counts.query_token_counts,
    "op13_tiled_source_divergence": divergence.query_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op6_prefix_filter_decontamination": decontamination.ORACLE,
    "op11_symmetric_delete_variants": spelling.ORACLE,
    "op13_tiled_source_divergence": divergence.ORACLE,
}
