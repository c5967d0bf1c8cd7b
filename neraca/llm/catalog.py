"""Named queries of the training-data operators, and their DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from neraca.llm import decontaminate, jaccard, languages, licenses, lines, manifest, mixing, neural, preferences, prefixes, quality, rules, shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_language_id": languages.op3_language_id,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_preference_pairs": preferences.op6_preference_pairs,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_sharding": shards.op9_sharding,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_prefix_trie": prefixes.op11_prefix_trie,
    "op12_language_model": neural.op12_language_model,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_preference_pairs": preferences.ORACLE,
        "op7_license_scan": licenses.oracle(),
        "op9_sharding": shards.oracle(),
        "op11_prefix_trie": prefixes.ORACLE,
        "op13_merkle_manifest": manifest.ORACLE,
    }
