"""The thirteen queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, langid, licenses, media, minhash, packing, pieces, pii, suffix, toxicity, vafile, whitening, wrappers

QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_media_columns": media.op2_media_columns,
    "op3_html_extraction": wrappers.op3_html_extraction,
    "op4_language_id": langid.op4_language_id,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_va_topk": vafile.op6_va_topk,
    "op7_pii": pii.op7_pii,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_whitening": whitening.op11_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES = {"op5_license_scan": licenses.oracle(), "op6_va_topk": vafile.ORACLE_OP6}
