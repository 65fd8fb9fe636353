"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from loomfeat.llm import chat, decontaminate, html, neardup, neighbours, pieces, pii, quality, tokencount, toxicity

QUERIES = {
    "op1_sentencepiece": pieces.op1,
    "op2_nearest_neighbours": neighbours.op2,
    "op3_quality_classifier": quality.op3,
    "op4_token_counts": tokencount.op4,
    "op5_toxicity": toxicity.op5,
    "op6_chat_formatting": chat.op6,
    "op7_html_extraction": html.op7,
    "op8_benchmark_decontamination": decontaminate.op8,
    "op9_minhash_near_dedup": neardup.op9,
    "op10_pii": pii.op10,
}
ORACLES: dict[str, str] = {"op6_chat_formatting": chat.ORACLE}
