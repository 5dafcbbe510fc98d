"""The queries of this package and their SQL."""

from __future__ import annotations

from . import op1_decontaminate, op2_lm, op3_counts, op4_packing, op5_embeddings, op6_quality, op7_chat, op8_langid, op9_secrets, op10_jaccard

QUERIES = {
    "op3_counts": op3_counts.query,
    "op5_embeddings": op5_embeddings.query,
    "op6_quality": op6_quality.query,
    "op8_langid": op8_langid.query,
    "op1_decontaminate": op1_decontaminate.query,
    "op10_jaccard": op10_jaccard.query,
    "op2_lm": op2_lm.query,
    "op4_packing": op4_packing.query,
    "op7_chat": op7_chat.query,
    "op9_secrets": op9_secrets.query,
}
ORACLES = {
    "op5_embeddings": op5_embeddings.ORACLE,
    "op10_jaccard": op10_jaccard.ORACLE,
    "op7_chat": op7_chat.ORACLE,
    "op9_secrets": op9_secrets.ORACLE,
}
