"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quarrymill.llm import bpe, collocations, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, ngram_join, packing, prefix_trie, sharding, topk, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_packing": packing.op7_packing,
        "op8_topk": topk.op8_topk,
        "op9_sharding": sharding.op9_sharding,
        "op10_bpe": bpe.op10_bpe,
        "op11_collocations": collocations.op11_collocations,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_language_id": language_id.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.ORACLE,
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op8_topk": topk.ORACLE,
        "op11_collocations": collocations.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
    }
