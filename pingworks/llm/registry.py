"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pingworks.llm import convrepair, htmltext, jaccard, licenses, media, mixing, packing, quality, tokencounts, tokenids, toxicity, variants, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_packing": packing.query,
    "op3_toxicity": toxicity.query,
    "op4_license_scan": licenses.query,
    "op5_warc": warc.query,
    "op6_jaccard_join": jaccard.query,
    "op7_token_ids": tokenids.query,
    "op8_media": media.query,
    "op9_token_counts": tokencounts.query,
    "op10_quality_rules": quality.query,
    "op11_conversation_repair": convrepair.query,
    "op12_spelling_variants": variants.query,
    "op13_html_extraction": htmltext.query,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
    "op11_conversation_repair": convrepair.ORACLE_SQL,
    "op12_spelling_variants": variants.ORACLE_SQL,
}
