"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, hard_negatives, html, language, lexical, line_dedup, media, mixing, ngram_join, packing, quality, sharding, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_language_id": language.op2_language_id,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_mixing_sources": mixing.op7_mixing_sources,
    "op8_hilbert_sharding": sharding.op8_hilbert_sharding,
    "op9_media_columns": media.op9_media_columns,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_mixing_sources": mixing.ORACLE,
    "op10_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
