"""Questions, answers, and the delay until the accepted answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forumscope.functions.timing import delay_columns, moment
from forumscope.schemas import ANSWER, QUESTION


def questions(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("_PostTypeId") == QUESTION)


def answers(posts: DataFrame) -> DataFrame:
    """Answers under the names that the join with their question uses."""
    return posts.where(F.col("_PostTypeId") == ANSWER).select(
        F.col("_Id").alias("AnswerId"), F.col("_CreationDate").alias("AcceptedAnswerCreationDate")
    )


def accepted_questions(posts: DataFrame) -> DataFrame:
    return questions(posts).where(F.col("_AcceptedAnswerId").isNotNull())


def question_base(posts: DataFrame) -> DataFrame:
    """Questions with the accepted flag and the year and month they were asked."""
    asked = moment(F.col("_CreationDate"))
    return questions(posts).select(
        "_Id",
        "_PostTypeId",
        "_AcceptedAnswerId",
        "_ViewCount",
        "_Score",
        "_Tags",
        "_AnswerCount",
        F.col("_AcceptedAnswerId").isNotNull().cast("int").alias("is_answer"),
        F.year(asked).alias("Year"),
        F.month(asked).alias("Month"),
    )


def questions_since(posts: DataFrame, after_year: int) -> DataFrame:
    """Questions asked after the given year.

    ISO text sorts by time, so the first comparison stays on the stored column and reaches the scan; the second
    drops text that is no date.
    """
    asked = F.col("_CreationDate")
    return questions(posts).where((asked >= f"{after_year + 1:04d}") & (F.year(moment(asked)) > after_year))


def post_counts(posts: DataFrame) -> DataFrame:
    """All table and filter counts in one pass."""
    is_question = F.col("_PostTypeId") == QUESTION
    accepted = F.col("_AcceptedAnswerId").isNotNull()
    return posts.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(is_question).alias("questions"),
        F.count_if(F.col("_PostTypeId") == ANSWER).alias("answers"),
        F.count_if(is_question & accepted).alias("accepted_questions"),
        F.count_if(is_question & ~accepted).alias("not_accepted_questions"),
        F.count_if(is_question & (F.coalesce(F.col("_AnswerCount"), F.lit(0)) == 0)).alias("unanswered_questions"),
    )


def questions_per_year(posts: DataFrame) -> DataFrame:
    asked = questions(posts).select(F.year(moment(F.col("_CreationDate"))).alias("Year"))
    return asked.groupBy("Year").agg(F.count(F.lit(1)).alias("n_questions"))


def with_accepted_answer(asked: DataFrame, answered: DataFrame, keep_open: bool = False) -> DataFrame:
    """Questions joined to their accepted answer, with the delay columns.

    Ids that match no answer are dropped, or kept with null delays when ``keep_open`` is set. Then
    questions without an accepted id get a key of their own that no answer has: they would otherwise
    all hash to one partition.
    """
    if keep_open:
        key = F.coalesce(F.col("_AcceptedAnswerId"), -1 - F.col("_Id"))
        joined = asked.withColumn("_answer_key", key).join(
            answered, F.col("_answer_key") == F.col("AnswerId"), "left"
        )
        joined = joined.drop("_answer_key")
    else:
        joined = asked.join(answered, F.col("_AcceptedAnswerId") == F.col("AnswerId"))
    return joined.withColumns(
        delay_columns(moment(F.col("_CreationDate")), moment(F.col("AcceptedAnswerCreationDate")))
    )


def answer_delay(posts: DataFrame) -> DataFrame:
    """Accepted questions with the year asked and the delay until the accepted answer."""
    asked = accepted_questions(posts).select(
        "_Id", "_AcceptedAnswerId", "_CreationDate", "_ViewCount", "_Score", "_Tags", "_AnswerCount"
    )
    return (
        with_accepted_answer(asked, answers(posts))
        .withColumn("Year", F.year(moment(F.col("_CreationDate"))))
        .withColumnRenamed("_Id", "QuestionId")
        .drop("_AcceptedAnswerId", "_CreationDate", "AcceptedAnswerCreationDate")
    )


def question_at_delay(delays: DataFrame, days: int) -> DataFrame:
    """The first question, by id, whose accepted answer came after exactly this many days."""
    return delays.where(F.col("AnswerDurationDays") == days).orderBy("QuestionId").limit(1)
