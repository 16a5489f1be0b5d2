"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from docsift.llm import chat, decontaminate, html, language, packing, quality, simhash, token_files, toxicity, urls

QUERIES = {
    "op1_language": language.op1_language,
    "op2_urls": urls.op2_urls,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_chat": chat.op4_chat,
    "op5_token_files": token_files.op5_token_files,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_packing": packing.op7_packing,
    "op8_simhash": simhash.op8_simhash,
    "op9_html": html.op9_html,
    "op10_toxicity": toxicity.op10_toxicity,
}
#: The others rest on fitted models, tokenizers or iteration; their tests hold them against plain versions.
ORACLES = {
    "op3_quality_rules": quality.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
}
