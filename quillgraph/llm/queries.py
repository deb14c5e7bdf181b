"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from quillgraph.llm import bpe_codec, exact_dedup, exact_topk, lexical_search, license_scan, line_dedup, near_dedup, packing, prefix_trie, sharding, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_exact_topk": exact_topk.query,
    "op3_toxicity": toxicity.query,
    "op4_sharding": sharding.query,
    "op5_bpe_codec": bpe_codec.query,
    "op6_license_scan": license_scan.query,
    "op7_line_dedup": line_dedup.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_packing": packing.query,
    "op10_near_dedup": near_dedup.query,
    "op11_substring_dedup": substring_dedup.query,
    "op12_lexical_search": lexical_search.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLES = {
    "op2_exact_topk": exact_topk.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
