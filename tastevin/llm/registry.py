"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

from . import conversations, embedding_dup, language, mixing, near_dup, periodic, quality_classifier, quality_rules, spm, suffix_dedup, token_counts, toxicity, warc


def queries():
    return {
        "op1_pareto_mix": mixing.op1_pareto_mix,
        "op2_sentencepiece": spm.op2_sentencepiece,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language": language.op4_language,
        "op5_quality": quality_classifier.op5_quality,
        "op6_dart_minhash": near_dup.op6_dart_minhash,
        "op7_adaptive_rules": quality_rules.op7_adaptive_rules,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_pivot_permutation": embedding_dup.op10_pivot_permutation,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_warc": warc.op12_warc,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": mixing.SQL,
        "op6_dart_minhash": near_dup.SQL,
        "op7_adaptive_rules": quality_rules.SQL,
        "op8_suffix_dedup": suffix_dedup.SQL,
        "op10_pivot_permutation": embedding_dup.SQL,
        "op11_periodic_runs": periodic.SQL,
        "op12_warc": warc.SQL,
        "op13_conversation_repair": conversations.SQL,
    }
