"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, html_extract, mixing, packing, pii, quality, sharding, simhash, warc


def queries() -> dict:
    return {
        "op1_sharding": sharding.query,
        "op2_chat": chat.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_simhash": simhash.query,
        "op5_quality": quality.query,
        "op6_pii": pii.query,
        "op7_packing": packing.query,
        "op8_html": html_extract.query,
        "op9_mixing": mixing.query,
        "op10_warc": warc.query,
    }


def oracle_sql() -> dict:
    return {"op2_chat": chat.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op10_warc": warc.ORACLE}
