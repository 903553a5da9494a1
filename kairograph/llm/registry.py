"""The queries of this subpackage, and their SQL for the driver's comparison."""

from __future__ import annotations

from . import decontaminate, language, pii, sentencepiece_scan, sharding, simhash, token_counts, toxicity, vectors, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.query,
        "op2_decontamination": decontaminate.query,
        "op3_sentencepiece": sentencepiece_scan.query,
        "op4_token_counts": token_counts.query,
        "op5_warc": warc.query,
        "op6_sharding": sharding.query,
        "op7_pii": pii.query,
        "op8_toxicity": toxicity.query,
        "op9_embeddings": vectors.query,
        "op10_language": language.query,
    }


def oracle_sql() -> dict[str, str]:
    """XXH64, trained models, tokenizers and HTML have no SQL: those queries are tested against brute force."""
    return {
        "op2_decontamination": decontaminate.oracle_sql(),
        "op6_sharding": sharding.oracle_sql(),
        "op7_pii": pii.oracle_sql(),
        "op9_embeddings": vectors.oracle_sql(),
    }
