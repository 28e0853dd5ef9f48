"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from gridstat.llm import bpe, chat, decontaminate, divergence, langid, mixture, pii, quality, repair, simhash, token_counts, toxicity, winnow

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_simhash": simhash.op6_simhash,
    "op7_langid": langid.op7_langid,
    "op8_chat": chat.op8_chat,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_winnow": winnow.op10_winnow,
    "op11_divergence": divergence.op11_divergence,
    "op12_mixture": mixture.op12_mixture,
    "op13_repair": repair.op13_repair,
}

ORACLE_SQL = {
    "op1_pii": pii.OP1_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op8_chat": chat.OP8_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_mixture": mixture.OP12_SQL,
    "op13_repair": repair.OP13_SQL,
}
