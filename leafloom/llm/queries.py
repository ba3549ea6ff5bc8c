"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from leafloom.llm import audio, fingerprints, katz, language, licenses, mixing, neardup, packing, substrings, urls

QUERIES = {
    "op1_minhash": neardup.query,
    "op2_katz": katz.query,
    "op3_substrings": substrings.query,
    "op4_licenses": licenses.query,
    "op5_audio": audio.query,
    "op6_language": language.query,
    "op7_packing": packing.query,
    "op8_mixing": mixing.query,
    "op9_fingerprints": fingerprints.query,
    "op10_urls": urls.query,
}

SQL = {
    "op1_minhash": neardup.SQL,
    "op2_katz": katz.SQL,
    "op3_substrings": substrings.SQL,
    "op4_licenses": licenses.SQL,
    "op8_mixing": mixing.SQL,
    "op9_fingerprints": fingerprints.SQL,
    "op10_urls": urls.SQL,
}
