"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fim, langid, licenses, lm, packing, pieces, quality, simhash, suffix, superminhash, topk, warc, whitening


def queries() -> dict:
    return {
        "op1_license_scan": licenses.query,
        "op10_sentencepiece": pieces.query,
        "op11_embedding_whitening": whitening.query,
        "op12_minhash_near_dedup": superminhash.query,
        "op13_fill_in_middle": fim.query,
        "op2_best_fit_packing": packing.query,
        "op3_quality_rules": quality.query,
        "op4_simhash_near_dedup": simhash.query,
        "op5_lm_scoring": lm.query,
        "op6_exact_top_k": topk.query,
        "op7_warc": warc.query,
        "op8_suffix_dedup": suffix.query,
        "op9_language_id": langid.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.sql(),
        "op12_minhash_near_dedup": superminhash.sql(),
        "op13_fill_in_middle": fim.SQL,
        "op6_exact_top_k": topk.SQL,
    }
