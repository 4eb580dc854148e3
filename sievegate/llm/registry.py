"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sievegate.llm import bpe, digests, langid, lines, near, packing, quality, suffix, toxicity, tries, vectors, warc, wavelet


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_warc_normaliser": warc.op2_warc_normaliser,
        "op3_wavelet_matrix": wavelet.op3_wavelet_matrix,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_minhash_near_dedup": near.op8_minhash_near_dedup,
        "op9_fingerprints": digests.op9_fingerprints,
        "op10_suffix_dedup": suffix.op10_suffix_dedup,
        "op11_vector_codes": vectors.op11_vector_codes,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_prefix_trie": tries.op13_prefix_trie,
    }


def oracle_sql() -> dict:
    return {"op2_warc_normaliser": warc.ORACLE, "op4_line_dedup": lines.ORACLE, "op6_quality_rules": quality.ORACLE, "op11_vector_codes": vectors.ORACLE, "op13_prefix_trie": tries.ORACLE}
