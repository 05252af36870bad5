"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import exact_dedup, langid, licenses, mixing, ngram_join, ogg, packing, pii, quality, suffix_dedup

QUERIES = {
    "op1_pii": pii.query,
    "op2_licenses": licenses.query,
    "op3_ogg": ogg.query,
    "op4_langid": langid.query,
    "op5_quality": quality.query,
    "op6_ngram_join": ngram_join.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_mixing": mixing.query,
    "op10_packing": packing.query,
}

#: Where SQL can express the operator.
ORACLE_SQL = {
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op6_ngram_join": ngram_join.CLASSES_SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_mixing": mixing.SQL,
}
