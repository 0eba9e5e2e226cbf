"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tuneline.llm import bpe, lexical, line_dedup, mixing, near_dup, nearest, periodic, pii, quality_classifier, quality_rules, token_counts, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_nearest": nearest.op6_nearest,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_pii": pii.op12_pii,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
}
