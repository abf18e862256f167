"""One query per text operator, with production parameters, over the operator's whole table."""

from __future__ import annotations

import os

from strandlog.llm import decontaminate, html_text, langid, line_dedup, near_dedup, oracles, pieces, pii, preference, quality, toxicity

#: Where the vocabulary files of public tokenizers are; they are never part of the repository.
TOKENIZERS = os.environ.get("STRANDLOG_TOKENIZERS", "/opt/tokenizers")

QUERIES: dict = {
    "op10_language_id": langid.query,
    "op1_chat_formatting": preference.query,
    "op2_toxicity": toxicity.query,
    "op3_decontamination": decontaminate.query,
    "op4_quality_rules": quality.query,
    "op5_pii": pii.query,
    "op6_line_dedup": line_dedup.query,
    "op7_near_dedup": near_dedup.query,
    "op8_html_extraction": html_text.query,
    "op9_sentencepiece": lambda spark, sf_dir: pieces.query(spark, sf_dir, f"{TOKENIZERS}/piece_bpe_32k.model"),
}

ORACLES: dict = {
    "op6_line_dedup": oracles.LINE_DEDUP,
    "op7_near_dedup": oracles.NEAR_DEDUP,
    "op3_decontamination": decontaminate.ORACLE,
    "op1_chat_formatting": preference.ORACLE,
}
