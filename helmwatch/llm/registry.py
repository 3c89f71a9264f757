"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from helmwatch.llm import bpe, exact_dedup, html_extract, jaccard, lm_score, media, packing, pii, quality, resampling, sharding, substring_dedup, vector_codes

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_html": html_extract.op4_html,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_media_copies": media.op9_media_copies,
    "op10_pii": pii.op10_pii,
    "op11_sharding": sharding.op11_sharding,
    "op12_resampling": resampling.op12_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_sharding": sharding.OP11_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
