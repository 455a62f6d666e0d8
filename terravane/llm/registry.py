"""The queries of these operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, language_id, minhash_dedup, mixing, periodic_runs, pii, quality, substring_dedup, suffix_dedup, toxicity, vector_codes

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_language_id": language_id.op4_language_id,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_minhash_dedup": minhash_dedup.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_periodic_runs": periodic_runs.ORACLE,
    "op13_substring_dedup": substring_dedup.ORACLE,
}
