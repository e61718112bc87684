"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from provenlace.llm import (
    alignment,
    chat_format,
    decontaminate,
    divergence,
    exact_dedup,
    language_id,
    line_dedup,
    mixing,
    quality,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_shard_documents": sharding.op1_shard_documents,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": language_id.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_align_tokenizers": alignment.op12_align_tokenizers,
    "op13_quality": quality.op13_quality,
}

ORACLE = {
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_source_divergence": divergence.SQL,
}
