"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, divergence, hard_negatives, line_dedup, mixing, near_dedup, quality, substring_dedup, suffix_dedup, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_quality": quality.op7_quality,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_nearest": ann.op9_nearest,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_topk": topk.op12_topk,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.OP1_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_topk": topk.OP12_SQL, "op13_divergence": divergence.OP13_SQL}
