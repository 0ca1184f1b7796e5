"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from rosterloom.llm import chat, exact_dedup, html_text, media, mixing, ngram_join, packing, quality, secrets, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_chat": chat.op2_chat,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_html_text": html_text.op6_html_text,
    "op7_media": media.op7_media,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_packing": packing.op9_packing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLE_SQL = {
    "op1_secrets": secrets.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
