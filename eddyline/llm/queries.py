"""Registered queries of this subpackage, and their SQL where SQL has one."""

from __future__ import annotations

from eddyline.llm import (
    decontaminate, line_dedup, lm, mixing, personal, pieces, quality, simhash, spelling, suffix_dedup,
    token_rollup, topk, whitening,
)

QUERIES = {
    "op1_mix_to_targets": mixing.op1_mix_to_targets,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sentencepiece_gumbel": pieces.op3_sentencepiece_gumbel,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_personal_data": personal.op5_personal_data,
    "op6_quality_perplexity": quality.op6_quality_perplexity,
    "op7_lm_log_bilinear": lm.op7_lm_log_bilinear,
    "op8_token_rollups": token_rollup.op8_token_rollups,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_simhash_pigeonring": simhash.op10_simhash_pigeonring,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op9_exact_topk": topk.ORACLE_SQL,
    "op11_decontaminate": decontaminate.ORACLE_SQL,
}
