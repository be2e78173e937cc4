"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bagminhash, bpe, chat, chroma, decontam, hpylm, infill, langid, licenses, ngram_join, quantize, secrets, substring

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_audio_align": chroma.op5_audio_align,
    "op6_bpe_encode": bpe.op6_bpe_encode,
    "op7_lm_score": hpylm.op7_lm_score,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_near_dedup": bagminhash.op9_near_dedup,
    "op10_language_id": langid.op10_language_id,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_vector_codes": quantize.op12_vector_codes,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
ORACLES = {
    "op1_chat_format": chat.ORACLE,
    "op3_substring_dedup": substring.ORACLE,
    "op4_secret_scan": secrets.ORACLE,
    "op9_near_dedup": bagminhash.ORACLE,
    "op11_ngram_join": ngram_join.ORACLE,
    "op12_vector_codes": quantize.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
