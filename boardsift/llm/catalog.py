"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from boardsift.llm import (
    bpe, chat, clusters, codes, decontam, html, interpolation, jaccard, language, pii, quality, rules, secrets,
)

QUERIES = {
    "op1_latent_leaks": decontam.op1_latent_leaks,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op2_language": language.op2_language,
    "op6_quality": quality.op6_quality,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_wrapper_text": html.op8_wrapper_text,
    "op10_preference_pairs": chat.op10_preference_pairs,
    "op3_decision_list": rules.op3_decision_list,
    "op4_pii_bootstrap": pii.op4_pii_bootstrap,
    "op9_secret_ledger": secrets.op9_secret_ledger,
    "op11_deleted_interpolation": interpolation.op11_deleted_interpolation,
    "op12_walsh_codes": codes.op12_walsh_codes,
    "op13_rotated_clusters": clusters.op13_rotated_clusters,
}

ORACLES: dict[str, str] = {
    "op10_preference_pairs": chat.ORACLE,
    "op12_walsh_codes": codes.sql(),
    "op13_rotated_clusters": clusters.sql(),
}
