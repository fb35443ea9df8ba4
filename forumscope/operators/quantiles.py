"""Exact medians and quartiles of integer columns for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here a group is cut
into buckets of 65,536 neighbouring values. Bucket totals locate the bucket that holds each wanted
rank, and only the rows of those buckets are put in order. No task ever sorts more than the buckets of
one group or the values of one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BUCKET_BITS = 16


def value_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Occurrences of each value of each column within each group: (keys, metric, value, n).

    Only for integer columns: a fraction would be cut off.
    """
    kinds = dict(df.select(*columns).dtypes)
    if wrong := [c for c, kind in kinds.items() if kind not in ("tinyint", "smallint", "int", "bigint", "boolean")]:
        raise ValueError(f"exact quantiles need integer columns, not {', '.join(wrong)}")
    pairs = ", ".join(f"struct('{c}' AS metric, CAST({c} AS BIGINT) AS value)" for c in columns)
    return (
        df.selectExpr(*keys, f"inline(array({pairs}))")
        .where("value IS NOT NULL")
        .groupBy(*keys, "metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def group_profile(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float] = (0.5,)
) -> DataFrame:
    """Per group and column: ``<c>_n`` non-null rows, ``<c>_sum``, and ``<c>_q<i>`` for each probability.

    Quantiles interpolate between the two neighbouring ranks, as the built-in percentile does.
    """
    group = [*keys, "metric"]
    group_list = ", ".join(group)
    counts = value_counts(df, keys, columns).selectExpr(
        *group, "value", "n", f"shiftright(value, {BUCKET_BITS}) AS bucket"
    )

    buckets = counts.groupBy(*group, "bucket").agg(
        F.expr("sum(n) AS n"), F.expr("sum(n * value) AS weight")
    )
    placed = buckets.selectExpr(
        *group,
        "bucket",
        "n",
        f"sum(n) OVER (PARTITION BY {group_list} ORDER BY bucket) - n AS below",
        f"sum(n) OVER (PARTITION BY {group_list}) AS total",
        f"sum(weight) OVER (PARTITION BY {group_list}) AS weight",
    )
    ranks = [rank for p in probabilities for rank in _ranks(p)]
    targets = placed.where(" OR ".join(_covers("below", rank) for rank in ranks))

    at = [*group, "bucket"]
    matches = " AND ".join(f"{c} <=> t_{c}" for c in at)
    renamed = targets.selectExpr(*[f"{c} AS t_{c}" for c in at], "below", "total", "weight")
    ordered = counts.join(renamed, F.expr(matches)).selectExpr(
        *group,
        "value",
        "n",
        "total",
        "weight",
        f"below + sum(n) OVER (PARTITION BY {group_list}, bucket ORDER BY value) - n AS before",
    )

    results = []
    for c in columns:
        mine = f"metric = '{c}'"
        results.append(f"max(total) FILTER (WHERE {mine}) AS {c}_n")
        results.append(f"max(weight) FILTER (WHERE {mine}) AS {c}_sum")
        for i, p in enumerate(probabilities):
            low, high = [f"max(value) FILTER (WHERE {mine} AND {_covers('before', r)})" for r in _ranks(p)]
            position = f"{p!r}D * (max(total) FILTER (WHERE {mine}) - 1)"
            results.append(f"{low} + ({high} - {low}) * ({position} - floor({position})) AS {c}_q{i}")
    return ordered.groupBy(*keys).agg(*[F.expr(r) for r in results])


def _ranks(probability: float) -> tuple[str, str]:
    """The two zero-based ranks between which a quantile of ``total`` rows lies."""
    position = f"{probability!r}D * (total - 1)"
    return f"floor({position})", f"ceil({position})"


def _covers(before: str, rank: str) -> str:
    return f"({before} <= {rank} AND {rank} < {before} + n)"
