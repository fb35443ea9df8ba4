"""Ranges, histograms, box statistics, correlation and regression over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, functions as F

from forumscope.operators.quantiles import group_profile

# Correlation of two columns that are null together; null, not an error, when either is constant.
PEARSON = "try_divide(covar_pop(x, y), stddev_pop(x) * stddev_pop(y))"


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and non-null count of each column, from one pass."""
    values = df.selectExpr(_rows([f"struct('{c}' AS metric, CAST({c} AS DOUBLE) AS v)" for c in columns]))
    return values.groupBy("metric").agg(
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.count("v").alias("n_values")
    )


def share_at_least(df: DataFrame, sentiment: str, threshold: float, columns: Sequence[str]) -> DataFrame:
    """For each column, the share of its non-null rows that reach the sentiment threshold."""
    reached = F.col(sentiment) >= threshold
    return df.agg(
        *[
            F.try_divide(F.count_if(reached & F.col(c).isNotNull()), F.count(c)).alias(f"share_{c}")
            for c in columns
        ]
    )


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Rows in each interval ``(lo, hi]``, the first one closed on both sides; empty ones included.

    ``edges`` rise. The bin number is arithmetic on the row, so only one partial count for each bin and
    task is shuffled. It is never null and never filtered: a filter on it would be pushed into the scan
    and compute the column again for every edge. Rows outside all bins get 0, which no interval matches.
    """
    bounds = [f"{float(e)!r}D" for e in edges]
    passed = " + ".join(f"CAST(v > {bound} AS INT)" for bound in bounds)
    number = f"coalesce(CASE WHEN v = {bounds[0]} THEN 1 WHEN v <= {bounds[-1]} THEN {passed} END, 0)"
    filled = (
        df.select(F.col(column).cast("double").alias("v"))
        .groupBy(F.expr(number).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    intervals = [
        f"struct({i + 1} AS bin, {lo} AS lo, {hi} AS hi)" for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))
    ]
    slots = df.sparkSession.range(1).selectExpr(_rows(intervals))
    return slots.join(filled, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def even_edges(df: DataFrame, column: str, bins: int, start: float | None = None) -> list[float]:
    """Edges of equal steps from ``start``, or the minimum, to the maximum of a column.

    Without values all edges are ``start`` or 0, so that a histogram has its bins, with no rows.
    """
    value = F.col(column).cast("double")
    lowest, high = df.agg(F.min(value), F.max(value)).first()
    if high is None:
        lowest = high = 0.0 if start is None else float(start)
    low = lowest if start is None else float(start)
    return [low, *[low + (high - low) * (i / bins) for i in range(1, bins)], high]


def equal_width_histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Counts over equal-width bins between minimum and maximum, for several columns at once.

    Bins are closed on the left; the maximum falls in the last one, and a constant column fills the first.
    """
    extent = df.agg(
        *[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]
    ).first()
    cells = []
    for i, c in enumerate(columns):
        lo, hi = extent[2 * i], extent[2 * i + 1]
        width = (hi - lo) / bins if lo is not None else 0.0
        place = f"least(floor((CAST({c} AS DOUBLE) - {lo!r}D) / {width!r}D), {bins - 1})" if width else "0"
        cells.append(f"struct('{c}' AS metric, CASE WHEN {c} IS NOT NULL THEN CAST({place} AS INT) END AS bin)")
    return (
        df.selectExpr(_rows(cells))
        .where("bin IS NOT NULL")
        .groupBy("metric", "bin")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def box_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact quartiles, whiskers at 1.5 times the quartile range, and outliers of integer columns."""
    quartiles = group_profile(df, [], columns, (0.25, 0.5, 0.75)).selectExpr(
        _rows([f"struct('{c}' AS metric, {c}_q0 AS q1, {c}_q1 AS median, {c}_q2 AS q3)" for c in columns])
    )
    values = df.selectExpr(
        _rows([f"struct('{c}' AS metric, CAST({c} AS DOUBLE) AS value)" for c in columns])
    ).where("value IS NOT NULL")
    inside = "value BETWEEN q1 - 1.5D * (q3 - q1) AND q3 + 1.5D * (q3 - q1)"
    return (
        values.join(F.broadcast(quartiles), "metric")
        .groupBy("metric", "q1", "median", "q3")
        .agg(
            F.expr(f"min(value) FILTER (WHERE {inside}) AS whisker_low"),
            F.expr(f"max(value) FILTER (WHERE {inside}) AS whisker_high"),
            F.expr(f"count_if(NOT ({inside})) AS n_outliers"),
        )
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as rows (a, b, r), from one pass.

    Each pair uses the rows where both are present; a constant column has a null correlation. Pairs are
    combined in the task that reads the rows, so the shuffle holds one row for each pair and task.
    """
    pairs = [
        f"struct('{a}' AS a, '{b}' AS b, {_paired(a, b)} AS x, {_paired(b, a)} AS y)"
        for a, b in combinations_with_replacement(columns, 2)
    ]
    return df.selectExpr(_rows(pairs)).groupBy("a", "b").agg(F.expr(f"{PEARSON} AS r"))


def regression(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """Least-squares line of each ``y`` on ``x``: slope, intercept and share of variance explained."""
    points = [f"struct('{y}' AS metric, {_paired(x, y)} AS x, {_paired(y, x)} AS y)" for y in ys]
    slope = "try_divide(covar_pop(y, x), var_pop(x))"
    return (
        df.selectExpr(_rows(points))
        .groupBy("metric")
        .agg(
            F.expr(f"{slope} AS slope"),
            F.expr(f"avg(y) - {slope} * avg(x) AS intercept"),
            F.expr(f"pow({PEARSON}, 2) AS r2"),
        )
    )


def _paired(column: str, other: str) -> str:
    return f"CASE WHEN {other} IS NOT NULL THEN CAST({column} AS DOUBLE) END"


def _rows(structs: Sequence[str]) -> str:
    """Several structs of one row as rows of their own."""
    return f"inline(array({', '.join(structs)}))"
