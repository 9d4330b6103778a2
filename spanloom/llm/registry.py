"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, line_dedup, lm, mil_quality, packing, pieces, pii, quality_rules, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_lm_score": lm.op2,
    "op3_quality_mil": mil_quality.op3,
    "op4_toxicity": toxicity.op4,
    "op5_sentencepiece": pieces.op5,
    "op6_pii": pii.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_packing": packing.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_line_dedup": line_dedup.op10,
}
SQL = {"op7_exact_dedup": exact_dedup.SQL7, "op9_quality_rules": quality_rules.SQL9}
