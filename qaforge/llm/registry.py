"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import chat, clustering, decontamination, filter_audit, language_model, ngram_join, packing, simhash, substring_dedup, token_counts, token_store, top_k, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_toxicity": toxicity.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_token_store": token_store.query,
    "op5_top_k_search": top_k.query,
    "op6_language_model": language_model.query,
    "op7_chat_format": chat.query,
    "op8_decontamination": decontamination.query,
    "decontamination_proximity": decontamination.proximity_query,
    "op9_best_fit_packing": packing.query,
    "op10_token_counts": token_counts.query,
    "op11_simhash_near_dedup": simhash.query,
    "op12_filter_audit": filter_audit.query,
    "op13_centroid_clustering": clustering.query,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op5_top_k_search": top_k.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_centroid_clustering": clustering.ORACLE,
}
