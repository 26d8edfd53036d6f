"""The queries of this package, and SQL where it can express them."""

from __future__ import annotations

from panelark.llm import bpe, conversations, decontamination, jaccard, language_id, licenses, lm_scoring, quality, secrets, substring_dedup, token_files, url_filter, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_token_files": token_files.query,
    "op3_decontamination": decontamination.query,
    "op4_secrets": secrets.query,
    "op5_url_filter": url_filter.query,
    "op6_bpe": bpe.query,
    "op7_quality": quality.query,
    "op8_jaccard": jaccard.query,
    "op9_language_id": language_id.query,
    "op10_lm_scoring": lm_scoring.query,
    "op11_vector_codes": vector_codes.query,
    "op12_licenses": licenses.query,
    "op13_conversations": conversations.query,
}
ORACLES: dict[str, str] = {"op11_vector_codes": vector_codes.ORACLE}
