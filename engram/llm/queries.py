"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, html_extract, line_dedup, lm_score, minhash, mixing, substring_dedup, topk, toxicity, vector_dedup

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_bpe": bpe.op4_bpe,
    "op5_html": html_extract.op5_html,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_topk": topk.op7_topk,
    "op8_vector_dedup": vector_dedup.op8_vector_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_minhash": minhash.op10_minhash,
}
ORACLES = {
    "op7_topk": topk.SQL,
    "op8_vector_dedup": vector_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
