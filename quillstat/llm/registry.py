"""Queries of this subpackage and the SQL that says the same, for __spark_entry__."""

from __future__ import annotations

from . import chat_format, conversation_repair, decontamination, exact_dedup, language_id, mixing, ngram_join, phrases, sharding, substring_dedup, token_files, toxicity, warc


def queries() -> dict:
    from corpus_pipeline import run

    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_kd_shards": sharding.op5_kd_shards,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_warc_fixity": warc.op7_warc_fixity,
        "op8_chat_perspectives": chat_format.op8_chat_perspectives,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_token_files": token_files.op12_token_files,
        "op13_collocations": phrases.op13_collocations,
        "pipeline": run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_source_mix": mixing.OP2_SQL,
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op7_warc_fixity": warc.OP7_SQL,
        "op8_chat_perspectives": chat_format.OP8_SQL,
        "op10_ngram_join": ngram_join.OP10_SQL,
        "op11_conversation_repair": conversation_repair.OP11_SQL,
        "op13_collocations": phrases.OP13_SQL,
    }
