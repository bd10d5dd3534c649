"""The numbered queries and their oracles."""

from __future__ import annotations

import corpus_pipeline

from tidemark.llm import chat, decontam, fingerprints, linededup, mixing, ngram_lm, packing, repair, sharding, simhash, substring, toxicity, wand


def queries() -> dict:
    return {
        "op1_fingerprint": fingerprints.op1_fingerprint,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_pack_tokens": packing.op3_pack_tokens,
        "op4_ngram_score": ngram_lm.op4_ngram_score,
        "op5_shard_lpt": sharding.op5_shard_lpt,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_simhash": simhash.op7_simhash,
        "op8_decontaminate": decontam.op8_decontaminate,
        "op9_mix_systematic": mixing.op9_mix_systematic,
        "op10_line_dedup": linededup.op10_line_dedup,
        "op11_wand": wand.op11_wand,
        "op12_chat_format": chat.op12_chat_format,
        "op13_repair": repair.op13_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op2_substring_dedup": substring.OP2_SQL, "op8_decontaminate": decontam.OP8_SQL, "op10_line_dedup": linededup.OP10_SQL, "op11_wand": wand.OP11_SQL, "op12_chat_format": chat.OP12_SQL,
        "op13_repair": repair.OP13_SQL,
    }
