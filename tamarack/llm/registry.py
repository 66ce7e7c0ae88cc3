"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from tamarack.llm import flac, mixing, pii, secrets, sentencepiece_bpe, simhash, token_count, topk, toxicity, warc

QUERIES = {
    "op1_pii": pii.query,
    "op2_mixing": mixing.query,
    "op3_simhash": simhash.query,
    "op4_secrets": secrets.query,
    "op5_sentencepiece": sentencepiece_bpe.query,
    "op6_token_counts": token_count.query,
    "op7_warc": warc.query,
    "op8_top_k": topk.query,
    "op9_flac": flac.query,
    "op10_toxicity": toxicity.query,
}

ORACLE_SQL = {"op2_mixing": mixing.SQL, "op7_warc": warc.SQL, "op8_top_k": topk.SQL}
