"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from chatloom.llm import chat_format, decontaminate, language, line_dedup, lm, mixing, near_dedup, secrets, spelling, topk, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_url_template_filter": url_filter.query,
    "op2_line_winnowing": line_dedup.query,
    "op3_toxicity_knn": toxicity.query,
    "op4_chat_prefix_target": chat_format.query,
    "op5_fm_index_decontaminate": decontaminate.query,
    "op6_minhash_components": near_dedup.query,
    "op7_secret_linking": secrets.query,
    "op8_pitman_yor_scores": lm.query,
    "op9_mix_sources": mixing.query,
    "op10_exact_topk": topk.query,
    "op11_crf_language": language.query,
    "op12_wildcard_spelling": spelling.query,
    "op13_yinyang_codes": vector_codes.query,
}

ORACLES = {
    "op4_chat_prefix_target": chat_format.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op12_wildcard_spelling": spelling.ORACLE,
    "op13_yinyang_codes": vector_codes.ORACLE,
}
