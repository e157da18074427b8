"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from jaglet.llm import decontaminate, hnsw, htmlextract, jaccard, langid, linededup, packing, pii, tokencounts, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_html_extraction": htmlextract.op3_html_extraction,
    "op4_language_id": langid.op4_language_id,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": tokencounts.op8_token_counts,
    "op9_personal_data": pii.op9_personal_data,
    "op10_embedding_near_dedup": hnsw.op10_embedding_near_dedup,
}
ORACLES = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op10_embedding_near_dedup": hnsw.OP10_SQL,
}
