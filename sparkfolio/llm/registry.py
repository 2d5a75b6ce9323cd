"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, divergence, html, minhash, mixing, neardup, quality, resampling, sharding, substrings, suffixes, target_encoding


def queries() -> dict:
    return {
        "op1_sharding": sharding.query,
        "op2_ann": ann.query,
        "op3_quality": quality.query,
        "op4_neardup": neardup.query,
        "op5_minhash": minhash.query,
        "op6_substrings": substrings.query,
        "op7_suffixes": suffixes.query,
        "op8_html": html.query,
        "op9_bpe": bpe.query,
        "op10_mixing": mixing.query,
        "op11_resampling": resampling.query,
        "op12_target_encoding": target_encoding.query,
        "op13_divergence": divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.ORACLE_SQL,
        "op4_neardup": neardup.ORACLE_SQL,
        "op6_substrings": substrings.ORACLE_SQL,
        "op11_resampling": resampling.ORACLE_SQL,
        "op12_target_encoding": target_encoding.ORACLE_SQL,
        "op13_divergence": divergence.ORACLE_SQL,
    }
