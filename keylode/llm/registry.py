"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from keylode.llm import chat, decontaminate, langid, merkle, near, packing, quality, repeats, sharding, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_sharding,
        repeats.op2_suffix_array_dedup,
        merkle.op3_fingerprints,
        quality.op4_quality,
        langid.op5_language_id,
        toxicity.op6_toxicity,
        decontaminate.op7_decontamination,
        packing.op8_packing,
        near.op9_near_dedup,
        chat.op10_chat_formatting,
    )
}

ORACLE_SQL = {"op7_decontamination": decontaminate.SQL, "op9_near_dedup": near.SQL}
