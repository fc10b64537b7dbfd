"""The numbered operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from twinframe.llm import chat, decontamination, language, lm, merkle, mixing, phrases, pii, quality, simhash, substrings, tokens, urls

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_tokens": tokens.op2_tokens,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_pii": pii.op5_pii,
    "op6_lm_score": lm.op6_lm_score,
    "op7_substrings": substrings.op7_substrings,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_language": language.op10_language,
    "op11_manifest": merkle.op11_manifest,
    "op12_chat": chat.op12_chat,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES = {
    "op1_url_filter": urls.ORACLE,
    "op3_quality": quality.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op11_manifest": merkle.ORACLE,
    "op12_chat": chat.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
