"""The registered queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from meshwave.llm import decontaminate, fingerprint, langid, near_dedup, packing, passages, quality, token_counts, url_rules, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_language_id": langid.op4_language_id,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_order_minhash": fingerprint.op6_order_minhash,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_substring_dedup": passages.op9_substring_dedup,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": warc.OP1_SQL}
