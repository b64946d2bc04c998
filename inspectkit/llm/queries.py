"""The registered corpus queries and their DuckDB twins."""

from __future__ import annotations

from inspectkit.llm import bpe, contamination, copies, jaccard, quality, search, sharding, spelling, substring, suffix, topk, toxicity, warc

QUERIES = {
    "op1_bpe_codec": bpe.query,
    "op2_decontamination": contamination.query,
    "op3_toxicity": toxicity.query,
    "op4_hash_tree_sharding": sharding.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_quality_resampling": quality.query,
    "op7_suffix_dedup": suffix.query,
    "op8_substring_dedup": substring.query,
    "op9_exact_topk": topk.query,
    "op10_warc": warc.query,
    "op11_spelling_variants": spelling.query,
    "op12_ranked_search": search.query,
    "op13_exact_dedup": copies.query,
}

ORACLE_SQL = {
    "op8_substring_dedup": substring.SQL,
    "op9_exact_topk": topk.SQL,
    "op10_warc": warc.SQL,
    "op12_ranked_search": search.SQL,
    "op13_exact_dedup": copies.SQL,
}
