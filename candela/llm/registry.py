"""The subpackage's queries and their DuckDB SQL, by name."""

from __future__ import annotations

from . import align, bitsliced, bpe, host_rules, html_layout, lang_kernel, line_dedup, mixing, near_dup, periodic, quotes, rff_quality, winnow

QUERIES = {
    "op1_rff_quality": rff_quality.query,
    "op2_host_rules": host_rules.query,
    "op3_html_layout": html_layout.query,
    "op4_pivotal_mixing": mixing.query,
    "op5_line_dedup": line_dedup.query,
    "op6_language_kernel": lang_kernel.query,
    "op7_lsh_forest": near_dup.query,
    "op8_quote_linking": quotes.query,
    "op9_byte_bpe": bpe.query,
    "op10_bit_sliced_top_k": bitsliced.query,
    "op11_winnowing": winnow.query,
    "op12_periodic_runs": periodic.query,
    "op13_token_alignment": align.query,
}
ORACLES = {
    "op2_host_rules": host_rules.SQL,
    "op8_quote_linking": quotes.SQL,
    "op10_bit_sliced_top_k": bitsliced.SQL,
    "op11_winnowing": winnow.SQL,
}
