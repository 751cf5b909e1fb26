"""The contract's queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from gaugewright.llm import bpe, chat_format, decontam, embedding_dedup, language_id, line_dedup, quality, simhash, suffix_dedup, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_warc": warc.op2_warc,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality": quality.op8_quality,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_chat_format": chat_format.op10_chat_format,
}

SQL = {
    "op2_warc": warc.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_embedding_dedup": embedding_dedup.SQL,
    "op10_chat_format": chat_format.SQL,
}
