"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, fingerprint, jaccard, langid, licenses, linededup, neardup, packing, quality, repeats, spelling, vectors, whitening

QUERIES = {
    "op1_nearest": vectors.op1_nearest,
    "op2_suffix_dedup": repeats.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_licenses": licenses.op4_licenses,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_quality": quality.op10_quality,
    "op11_neardup": neardup.op11_neardup,
    "op12_whitening": whitening.op12_whitening,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL: dict[str, str] = {"op4_licenses": licenses.ORACLE, "op8_line_dedup": linededup.ORACLE, "op11_neardup": neardup.ORACLE}
