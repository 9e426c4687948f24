"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, minhash, mixing, oracles, projections, secrets, suffixes, toxicity, training_order

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_license_scan": licenses.op2,
        "op3_toxicity": toxicity.op3,
        "op4_training_order": training_order.op4,
        "op5_suffix_dedup": suffixes.op5,
        "op6_token_counts": bpe.op6,
        "op7_embedding_dedup": projections.op7,
        "op8_secrets": secrets.op8,
        "op9_minhash": minhash.op9,
        "op10_decontaminate": decontaminate.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": oracles.MIX, "op5_suffix_dedup": oracles.REPEATS, "op7_embedding_dedup": oracles.VECTORS, "op9_minhash": oracles.NEAR, "op10_decontaminate": oracles.LEAKS}
