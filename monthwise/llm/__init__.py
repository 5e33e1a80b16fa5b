"""Corpus operators for training-data pipelines, and their registered queries."""

from __future__ import annotations

from . import chat, decontamination, langid, mixing, negatives, pii, quality, sharding, similarity, substring, toxicity, trie, warc


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_sharding": sharding.op2_sharding,
        "op3_jaccard_join": similarity.op3_jaccard_join,
        "op4_pii": pii.op4_pii,
        "op5_mixing": mixing.op5_mixing,
        "op6_substring_dedup": substring.op6_substring_dedup,
        "op7_language_id": langid.op7_language_id,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_warc": warc.op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.OP1_SQL, "op5_mixing": mixing.OP5_SQL, "op11_prefix_trie": trie.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL, "op13_warc": warc.OP13_SQL}
