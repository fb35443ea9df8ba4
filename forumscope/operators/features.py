"""Outcome labels, the feature table, scaling and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumscope.operators.text import METRICS

# Outcome labels.
BEST, SOME, NONE = "BestAnswered", "Answered", "Unanswered"

# Short feature names, in the order of the metrics.
FEATURES = ("FG", "FE", "CL", "CP", "CSPT", "CSTT", "SENT")
COUNTERS = ("_Score", "_ViewCount", "_AnswerCount", "_CommentCount", "_FavoriteCount")


def with_outcome(posts: DataFrame) -> DataFrame:
    """Label each question by its answers: none, some, or an accepted one."""
    answered = F.coalesce(F.col("_AnswerCount"), F.lit(0)) > 0
    label = (
        F.when(answered & (F.col("_AcceptedAnswerId") > 0), BEST)
        .when(answered, SOME)
        .otherwise(NONE)
    )
    return posts.withColumn("target", label)


def outcome_counts(posts: DataFrame) -> DataFrame:
    return with_outcome(posts).groupBy("target").agg(F.count(F.lit(1)).alias("n_questions"))


def question_features(metrics: DataFrame) -> DataFrame:
    """Counters and text metrics as doubles without nulls, with the outcome label."""
    labelled = with_outcome(metrics)
    numbers = [F.col(c).cast("double").alias(c) for c in COUNTERS]
    numbers += [F.col(long).alias(short) for long, short in zip(METRICS, FEATURES)]
    filled = labelled.select("_Id", "_AcceptedAnswerId", *numbers, "target")
    return filled.na.fill(0.0, subset=[*COUNTERS, *FEATURES])


def with_label_index(df: DataFrame, column: str, output: str) -> DataFrame:
    """Number the labels of a column in alphabetical order, from zero."""
    indexer = StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc")
    return indexer.fit(df.select(column)).transform(df).withColumn(output, F.col(output).cast("int"))


@dataclass(frozen=True)
class Moments:
    """Means, sample deviations and correlations of columns: a square of numbers, whatever the number of rows."""

    columns: tuple[str, ...]
    means: np.ndarray
    deviations: np.ndarray
    correlations: np.ndarray

    def scaled(self) -> list[Column]:
        """Each column at mean 0 and deviation 1; a constant one is 0."""
        return [
            ((F.col(c) - F.lit(float(m))) / F.lit(float(d)) if d > 0 else F.lit(0.0)).alias(c)
            for c, m, d in zip(self.columns, self.means, self.deviations)
        ]


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """All moments in one aggregation, combined in the tasks that read the rows; one row reaches the driver."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = [F.avg(c) for c in columns] + [F.covar_samp(columns[i], columns[j]) for i, j in pairs]
    row = [x if x is not None and x == x else 0.0 for x in df.agg(*sums).first()]
    covariances = np.zeros((n, n))
    for (i, j), value in zip(pairs, row[n:]):
        covariances[i, j] = covariances[j, i] = value
    deviations = np.sqrt(covariances.diagonal())
    inverse = np.divide(1.0, deviations, out=np.zeros(n), where=deviations > 0)
    return Moments(tuple(columns), np.array(row[:n]), deviations, covariances * np.outer(inverse, inverse))


def scaled_columns(df: DataFrame, columns: Sequence[str], carry: Sequence[str]) -> DataFrame:
    return df.select(*carry, *moments(df, columns).scaled())


@dataclass(frozen=True)
class Components:
    """Principal components of scaled columns: a row of loadings each, and the variances of all components."""

    moments: Moments
    loadings: np.ndarray
    variances: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(len(self.loadings))]


def principal_components(of: Moments, k: int) -> Components:
    """The first k components; the largest loading of each is positive."""
    variances, vectors = np.linalg.eigh(of.correlations)
    order = np.argsort(variances)[::-1]
    loadings = vectors.T[order[:k]]
    largest = loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)]
    return Components(of, loadings * np.where(largest < 0, -1.0, 1.0)[:, None], np.maximum(variances[order], 0.0))


def fit_pca(df: DataFrame, columns: Sequence[str], k: int) -> Components:
    """Components from one pass over the rows."""
    return principal_components(moments(df, columns), k)


def pca_scores(df: DataFrame, model: Components, carry: Sequence[str]) -> DataFrame:
    """Each row's position on the components, as PC1, PC2 and so on: sums of products in the row itself."""
    scaled = df.select(*carry, *model.moments.scaled())
    sums = [
        sum((F.col(c) * F.lit(float(x)) for c, x in zip(model.moments.columns, row)), F.lit(0.0)).alias(name)
        for name, row in zip(model.names, model.loadings)
    ]
    return scaled.select(*carry, *sums)


def pca_variance(spark: SparkSession, model: Components) -> DataFrame:
    """Explained variance of each component: of the total, cumulated, and of the kept components."""
    ratios = (model.variances / model.variances.sum()).tolist()[: len(model.loadings)]
    kept = sum(ratios)
    rows = [
        (f"PC{i + 1}", ratio, sum(ratios[: i + 1]), ratio / kept) for i, ratio in enumerate(ratios)
    ]
    return spark.createDataFrame(rows, "pc STRING, ratio_total DOUBLE, cum_total DOUBLE, ratio_kept DOUBLE")


def pca_loadings(spark: SparkSession, model: Components) -> DataFrame:
    """Weight of each feature in each component."""
    rows = [
        (pc, feature, float(x))
        for pc, row in zip(model.names, model.loadings)
        for feature, x in zip(model.moments.columns, row)
    ]
    return spark.createDataFrame(rows, "pc STRING, feature STRING, loading DOUBLE")


def save_components(spark: SparkSession, model: Components, path: str) -> None:
    """A fitted model as one small table: a row for each feature, with its place, scale, correlations and loadings."""
    of = model.moments
    rows = [
        (i, c, float(of.means[i]), float(of.deviations[i]), of.correlations[i].tolist(), model.loadings[:, i].tolist(), float(model.variances[i]))
        for i, c in enumerate(of.columns)
    ]
    schema = "place INT, feature STRING, mean DOUBLE, deviation DOUBLE, correlations ARRAY<DOUBLE>, loadings ARRAY<DOUBLE>, variance DOUBLE"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


def load_components(spark: SparkSession, path: str) -> Components:
    rows = spark.read.parquet(path).orderBy("place").collect()
    of = Moments(
        tuple(r["feature"] for r in rows),
        np.array([r["mean"] for r in rows]),
        np.array([r["deviation"] for r in rows]),
        np.array([r["correlations"] for r in rows]),
    )
    return Components(of, np.array([r["loadings"] for r in rows]).T, np.array([r["variance"] for r in rows]))


def least_hashed(df: DataFrame, rows: int, seed: int, key: str = "_Id") -> DataFrame:
    """A random sample of exactly so many rows, or all: those of the least hash of their key.

    The rows do not follow partitions or order, and every task passes on its own least ones only.
    """
    return df.orderBy(hashed(seed, key), key).limit(rows)


def hashed(seed: int, key: str) -> Column:
    """The start of a hash of a row's key, as a number of 32 bits."""
    start = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8)
    return F.conv(start, 16, 10).cast("bigint")


def chosen(share: float, seed: int, key: str = "_Id") -> Column:
    """Whether a row is in a sample: by a hash of its key, so the same rows on any cluster and in any order."""
    return hashed(seed, key) / F.lit(float(1 << 32)) < share


def sample_by_year(posts: DataFrame, years: Sequence[int], fraction: float, seed: int) -> DataFrame:
    """The same share of the questions of each year, in one pass."""
    return posts.where(F.col("Year").isin(*years) & chosen(fraction, seed))


def correlation_of_components(spark: SparkSession, model: Components) -> DataFrame:
    """Correlations (a, b, r) rebuilt from all loadings and variances of a model on scaled columns."""
    columns = model.moments.columns
    rebuilt = (model.loadings.T * model.variances) @ model.loadings
    rows = [(a, b, float(rebuilt[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return spark.createDataFrame(rows, "a STRING, b STRING, r DOUBLE")
