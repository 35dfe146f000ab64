"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import cotraining, hard_negatives, katz, knn, licenses, mixing, odd_sketch, packing, prefix_trie, quality_rules, simhash, suffix_dedup, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_simhash": simhash.query,
    "op4_url_filter": url_filter.query,
    "op5_katz": katz.query,
    "op6_mixing": mixing.query,
    "op7_cotraining": cotraining.query,
    "op8_knn": knn.query,
    "op9_packing": packing.query,
    "op10_licenses": licenses.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_odd_sketch": odd_sketch.query,
    "op13_hard_negatives": hard_negatives.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_quality_rules": quality_rules.SQL, "op4_url_filter": url_filter.SQL, "op8_knn": knn.SQL, "op10_licenses": licenses.SQL, "op11_prefix_trie": prefix_trie.SQL, "op13_hard_negatives": hard_negatives.SQL}
