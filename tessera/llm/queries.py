"""The queries of this subpackage by name, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, crf, decontaminate, hmm, kneser_ney, packing, repair, rule_ensemble, simhash, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_token_ids": repair.op1_repair_token_ids,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_rule_ensemble_quality": rule_ensemble.op3_rule_ensemble_quality,
    "op4_crf_language_id": crf.op4_crf_language_id,
    "op5_hmm_language_model": hmm.op5_hmm_language_model,
    "op6_edit_decontamination": decontaminate.op6_edit_decontamination,
    "op7_chat_reconstruction": chat.op7_chat_reconstruction,
    "op8_url_markov_filter": url_filter.op8_url_markov_filter,
    "op9_kneser_ney_quality": kneser_ney.op9_kneser_ney_quality,
    "op10_pack_best_fit": packing.op10_pack_best_fit,
}

#: Models, fingerprints and tokenizers are not for SQL; tests/llm holds those queries against brute force.
SQL: dict[str, str] = {}
