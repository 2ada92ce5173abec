"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_text, jaccard_join, kneser_ney, line_dedup, pii, secrets, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_secrets": secrets.op2_secrets,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_html_text": html_text.op5_html_text,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_kneser_ney": kneser_ney.op8_kneser_ney,
    "op9_pii": pii.op9_pii,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
