"""Registered queries of this folder and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from convhist.llm import op1_adaptive, op2_bpe, op3_quotes, op4_suffix, op5_packing, op6_phrases, op7_arrow_tokens, op8_urls, op9_lines, op10_simhash, op11_byte_bpe, op12_squares, op13_fim

QUERIES = {
    "op1_adaptive_search": op1_adaptive.op1_adaptive_search,
    "op2_bpe_roundtrip": op2_bpe.op2_bpe_roundtrip,
    "op3_quotation_links": op3_quotes.op3_quotation_links,
    "op4_suffix_dedup": op4_suffix.op4_suffix_dedup,
    "op5_harmonic_packing": op5_packing.op5_harmonic_packing,
    "op6_phrase_dedup": op6_phrases.op6_phrase_dedup,
    "op7_arrow_tokens": op7_arrow_tokens.op7_arrow_tokens,
    "op8_url_verdicts": op8_urls.op8_url_verdicts,
    "op9_line_quality": op9_lines.op9_line_quality,
    "op10_simhash_components": op10_simhash.op10_simhash_components,
    "op11_word_shuffle_bpe": op11_byte_bpe.op11_word_shuffle_bpe,
    "op12_word_runs": op12_squares.op12_word_runs,
    "op13_skiplist_fim": op13_fim.op13_skiplist_fim,
}

CHECK_SQL = {
    "op6_phrase_dedup": op6_phrases.SQL,
    "op9_line_quality": op9_lines.SQL,
    "op13_skiplist_fim": op13_fim.SQL,
}
