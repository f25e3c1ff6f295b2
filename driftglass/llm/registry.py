"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from driftglass.llm import bpe, exact_dedup, fingerprints, lm_scoring, ngram_join, packing, quality, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_bpe": bpe.op8_bpe,
    "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

#: Operators 1, 4, 7, 8 and 10 have no SQL twin; their tests use brute force, round trips or held-out rows.
ORACLES = {
    "op2_lm_scoring": lm_scoring.ORACLE,
    "op3_ngram_jaccard_join": ngram_join.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op9_document_fingerprints": fingerprints.ORACLE,
}
