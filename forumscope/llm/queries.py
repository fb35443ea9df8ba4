"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forumscope.llm import (
    linededup,
    manifest,
    minhash,
    mixing,
    neighbours,
    packing,
    pii,
    resampling,
    rules,
    simhash,
    sitequality,
    suffixes,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_nearest": neighbours.op2_nearest,
    "op3_rules": rules.op3_rules,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality": sitequality.op7_quality,
    "op8_suffix": suffixes.op8_suffix,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_resample": resampling.op11_resample,
    "op12_manifest": manifest.op12_manifest,
    "op13_minhash": minhash.op13_minhash,
}

SQL: dict[str, str] = {
    "op10_mixing": mixing.OP10_SQL,
    "op11_resample": resampling.OP11_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_minhash": minhash.OP13_SQL,
}
