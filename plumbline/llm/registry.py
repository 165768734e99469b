"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import brown, chat, collocations, decontamination, importance, language_id, line_dedup, near_dedup, packing, quality, records, token_counts, topk

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_binary_records": records.op2_binary_records,
    "op3_language_id": language_id.op3_language_id,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_collocations": collocations.op11_collocations,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_brown_lm": brown.op13_brown_lm,
    "language_id_pages": language_id.language_id_pages,
}

ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op8_exact_topk": topk.OP8_SQL,
    "op9_minhash_near_dedup": near_dedup.OP9_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
}
