"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import chat, hnsw, jaccard, packing, quality_fm, sp_codec, suffix_dedup, topk, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_near_vectors": hnsw.op4_near_vectors,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality_fm.op6_quality,
    "op7_sentencepiece": sp_codec.op7_sentencepiece,
    "op8_tool_links": chat.op8_tool_links,
    "op9_top_k": topk.op9_top_k,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
}
SQL = {"op1_warc": warc.SQL, "op8_tool_links": chat.SQL, "op9_top_k": topk.SQL}
