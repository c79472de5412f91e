"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from folioscope.llm import byte_bpe, exact_dedup, hard_negatives, lm_score, media, mixing, near_dedup, quality, sharding, token_files, toxicity, url_filter, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_files": token_files.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_media_columns": media.op10_media_columns,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_sharding": sharding.op12_sharding,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
