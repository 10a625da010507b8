"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from callweave.llm import chat, class_ngrams, decontamination, line_dedup, mixing, near_duplicates, pairwise_quality, pipeline, prefix_trie, quality_rules, vector_codes, vector_links, warc, wavelet

QUERIES = {
    "op1_preference_format": chat.op1_preference_format,
    "op2_line_edit_join": line_dedup.op2_line_edit_join,
    "op3_class_bigrams": class_ngrams.op3_class_bigrams,
    "op4_ngram_jaccard_join": near_duplicates.op4_ngram_jaccard_join,
    "op5_benchmark_leaks": decontamination.op5_benchmark_leaks,
    "op6_warc_pages": warc.op6_warc_pages,
    "op7_wavelet_tokens": wavelet.op7_wavelet_tokens,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality_outliers": quality_rules.op9_quality_outliers,
    "op10_pairwise_quality": pairwise_quality.op10_pairwise_quality,
    "op11_member_resident_lloyd": vector_codes.op11_member_resident_lloyd,
    "op12_cross_polytope_links": vector_links.op12_cross_polytope_links,
    "op13_truncation_peeling": prefix_trie.op13_truncation_peeling,
    "pipeline": pipeline.run,
}

ORACLE = {**chat.ORACLE, **mixing.ORACLE, **warc.ORACLE, **vector_codes.ORACLE, **vector_links.ORACLE, **prefix_trie.ORACLE}
