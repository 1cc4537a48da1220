"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from millrace.llm import chat, decontaminate, gru, kneser_ney, language, packing, periodic, prefix_trie, rules, simhash, substring, suffix, topk

QUERIES = {
    "op1_quality_classifier": kneser_ney.op1_quality_classifier,
    "op2_quality_rules": rules.op2_quality_rules,
    "op3_packing": packing.op3_packing,
    "op4_language_id": language.op4_language_id,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_simhash_dedup": simhash.op7_simhash_dedup,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_lm_scoring": gru.op9_lm_scoring,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_exact_topk": topk.op11_exact_topk,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL: dict[str, str] = {
    "op2_quality_rules": rules.OP2_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op8_suffix_dedup": suffix.OP8_SQL,
    "op10_substring_dedup": substring.OP10_SQL,
    "op11_exact_topk": topk.OP11_SQL,
    "op12_periodic_runs": periodic.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
