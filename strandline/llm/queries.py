"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import html_text, licenses, mixing, neighbours, packing, quality_model, quality_rules, simhash, suffix_dedup, token_counts

QUERIES = {
    "op1_licenses": licenses.query,
    "op2_neighbours": neighbours.query,
    "op3_token_counts": token_counts.query,
    "op4_packing": packing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_simhash": simhash.query,
    "op7_quality_model": quality_model.query,
    "op8_mixing": mixing.query,
    "op8_mixing_blocks": mixing.blocks_query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_html_text": html_text.query,
}

SQL = {"op1_licenses": licenses.SQL, "op2_neighbours": neighbours.SQL, "op5_quality_rules": quality_rules.SQL, "op8_mixing": mixing.SQL, "op8_mixing_blocks": mixing.BLOCKS_SQL}
