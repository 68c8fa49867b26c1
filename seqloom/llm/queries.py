"""The registered query of each operator, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import ann, chat, exact_dedup, langid, line_dedup, mixing, ngram_join, packing, repair, secret_scan, suffix_dedup, topk, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_mixing": mixing.op4_mixing,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_top_k": topk.op9_top_k,
    "op10_language_id": langid.op10_language_id,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_nearest": ann.op13_nearest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op3_chat_format": chat.SQL,
    "op4_mixing": mixing.SQL,
    "op5_secret_scan": secret_scan.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op9_top_k": topk.SQL,
}
