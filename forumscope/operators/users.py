"""User reputation next to badges, scores, views and accepted answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from forumscope.schemas import ANSWER, BRONZE, GOLD, QUESTION, SILVER

BADGE_COUNTS = {"count_gold": GOLD, "count_silver": SILVER, "count_bronze": BRONZE}


def badge_counts(badges: DataFrame) -> DataFrame:
    """Badges of each user, in all and by class, in one aggregation."""
    by_class = [F.count_if(F.col("_Class") == c).alias(name) for name, c in BADGE_COUNTS.items()]
    return badges.groupBy("_UserId").agg(F.count(F.lit(1)).alias("count_all_badges"), *by_class)


def owner_totals(posts: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Post metrics of each owner, all from one pass over the posts that any of them needs."""
    kind, score = F.col("_PostTypeId"), F.col("_Score")
    accepted = F.col("_AcceptedAnswerId").isNotNull()
    recipes = {
        "answer_sum_score": (ANSWER, F.sum(F.when(kind == ANSWER, score))),
        "answer_avg_score": (ANSWER, F.avg(F.when(kind == ANSWER, score))),
        "question_sum_score": (QUESTION, F.sum(F.when(kind == QUESTION, score))),
        "question_avg_score": (QUESTION, F.avg(F.when(kind == QUESTION, score))),
        "question_sum_viewcount": (QUESTION, F.sum(F.when(kind == QUESTION, F.col("_ViewCount")))),
        "question_asked": (QUESTION, F.count_if(kind == QUESTION)),
        "question_answered": (QUESTION, F.count_if((kind == QUESTION) & accepted)),
    }
    kinds = {recipes[m][0] for m in metrics}
    return (
        posts.where(kind.isin(*sorted(kinds)) & F.col("_OwnerUserId").isNotNull())
        .groupBy("_OwnerUserId")
        .agg(*[recipes[m][1].alias(m) for m in metrics])
    )


def users_with(users: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Every user's reputation with a metric family; users without one get zeros."""
    metrics = [c for c in totals.columns if c != key]
    return (
        users.select("_Id", "_Reputation")
        .join(totals, F.col("_Id") == F.col(key), "left")
        .select("_Id", "_Reputation", *metrics)
        .na.fill(0, subset=["_Reputation", *metrics])
    )


def user_badges(users: DataFrame, badges: DataFrame) -> DataFrame:
    return users_with(users, badge_counts(badges), "_UserId")


def user_post_metric(users: DataFrame, posts: DataFrame, metric: str, output: str) -> DataFrame:
    totals = owner_totals(posts, [metric]).withColumnRenamed(metric, output)
    return users_with(users, totals, "_OwnerUserId")


def user_accepted_answers(users: DataFrame, posts: DataFrame) -> DataFrame:
    """Accepted answers of each owner; owners that are no user keep a null reputation.

    Accepted ids are counted before the join, so an id that is accepted often is one row by then.
    """
    accepted = (
        posts.where(F.col("_AcceptedAnswerId").isNotNull())
        .groupBy("_AcceptedAnswerId")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    owned = posts.where(F.col("_OwnerUserId").isNotNull()).select("_Id", "_OwnerUserId")
    per_owner = (
        accepted.join(owned, F.col("_AcceptedAnswerId") == F.col("_Id"))
        .groupBy(F.col("_OwnerUserId").alias("_Id"))
        .agg(F.sum("times").alias("count_accepted_answer"))
    )
    return per_owner.join(users.select("_Id", "_Reputation"), "_Id", "left")


def user_answered_share(users: DataFrame, posts: DataFrame) -> DataFrame:
    """Questions asked and answered by each owner, and the share answered."""
    totals = owner_totals(posts, ["question_asked", "question_answered"])
    share = F.round(F.col("question_answered") / F.col("question_asked"), 4)
    return (
        totals.withColumn("percent_answered", share)
        .join(users.select("_Id", "_Reputation"), F.col("_OwnerUserId") == F.col("_Id"), "left")
        .drop("_Id")
    )


def top_users(metric_table: DataFrame, metric: str, n: int) -> DataFrame:
    """The ``n`` users highest in a metric, ties by id."""
    return metric_table.orderBy(F.desc(metric), "_Id").limit(n)


def top_of_each(values: DataFrame, n: int) -> DataFrame:
    """The ``n`` users highest in each metric (metric, value), ties by id."""
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "_Id"))
    return (
        values.withColumn("place", place).where(F.col("place") <= n).select("metric", "_Id", "_Reputation", "value")
    )


def without_outliers(metric_table: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Rows whose metrics are all at or below their caps."""
    kept = metric_table
    for metric, cap in caps.items():
        kept = kept.where(F.col(metric) <= cap)
    return kept
