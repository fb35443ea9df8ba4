"""Tag popularity, coverage, trends and waiting times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from forumscope.functions.tags import distinct_tags, tag_list
from forumscope.operators.posts import question_base
from forumscope.operators.quantiles import group_profile

SHARE_PLACES = 12


def tags_questions(posts: DataFrame) -> DataFrame:
    """Questions with their tag array and the number of different tags."""
    return question_base(posts).select(
        "*",
        tag_list(F.col("_Tags")).alias("tags_arr"),
        distinct_tags(F.col("_Tags")).alias("TagCountPerPost"),
    ).drop("_Tags")


def tags_distribution(tagged: DataFrame) -> DataFrame:
    """One row for each question and tag."""
    return tagged.select(
        "_Id",
        "_ViewCount",
        "_Score",
        "_AnswerCount",
        "is_answer",
        "Year",
        "Month",
        "TagCountPerPost",
        F.explode("tags_arr").alias("Tag"),
    )


def tag_popularity(distribution: DataFrame, *also_by: str) -> DataFrame:
    """Frequency, exact median score and answer count, and accepted share by tag (and year)."""
    keys = ["Tag", *also_by]
    profile = group_profile(distribution, keys, ["is_answer", "_Score", "_AnswerCount"])
    return profile.select(
        *keys,
        F.col("is_answer_n").alias("tag_frequency"),
        F.col("_Score_q0").alias("med_score"),
        F.col("_AnswerCount_q0").alias("med_answer_count"),
        (F.col("is_answer_sum") / F.col("is_answer_n")).alias("percent_answer"),
    ).orderBy(F.desc("tag_frequency"), *keys)


def tag_frequency(distribution: DataFrame, *also_by: str) -> DataFrame:
    return distribution.groupBy("Tag", *also_by).agg(F.count(F.lit(1)).alias("tag_frequency"))


def tag_response(delays: DataFrame) -> DataFrame:
    """Exact median and mean waiting time for an accepted answer, by tag."""
    exploded = delays.select(
        F.explode(tag_list(F.col("_Tags"))).alias("Tag"),
        "_Score",
        "_AnswerCount",
        F.col("AnswerDurationSeconds").alias("seconds"),
        F.col("AnswerDurationDays").alias("days"),
        F.lit(1).alias("one"),
    )
    p = group_profile(exploded, ["Tag"], ["one", "_Score", "_AnswerCount", "seconds", "days"])
    hours = F.lit(3600.0)
    return p.select(
        "Tag",
        F.col("one_n").alias("tag_frequency"),
        F.col("_Score_q0").alias("med_score"),
        F.col("_AnswerCount_q0").alias("med_answer_count"),
        F.col("seconds_q0").alias("med_AnswerDurationSeconds"),
        (F.col("seconds_q0") / hours).alias("med_AnswerDurationHour"),
        F.col("days_q0").alias("med_AnswerDurationDays"),
        (F.col("seconds_sum") / F.col("seconds_n")).alias("avg_AnswerDurationSeconds"),
        (F.col("seconds_sum") / F.col("seconds_n") / hours).alias("avg_AnswerDurationHour"),
        (F.col("days_sum") / F.col("days_n")).alias("avg_AnswerDurationDays"),
    ).orderBy(F.desc("tag_frequency"), "Tag")


def tags_per_question(tagged: DataFrame) -> DataFrame:
    """Questions by number of tags: counts, and shares of all questions, tagged or not."""
    groups = tagged.groupBy("TagCountPerPost").agg(
        F.count(F.lit(1)).alias("num_question"),
        F.sum("is_answer").alias("num_question_with_answer"),
    )
    all_questions = groups.agg(F.sum("num_question")).scalar()
    answered = F.col("num_question_with_answer") / F.col("num_question")
    return groups.where(F.col("TagCountPerPost").isNotNull()).select(
        "TagCountPerPost",
        "num_question",
        "num_question_with_answer",
        (F.col("num_question") - F.col("num_question_with_answer")).alias("num_without_answer"),
        F.round(F.col("num_question") / all_questions, 4).alias("percent_all"),
        F.round(answered, 4).alias("percent_answer"),
        (1 - F.round(answered, 4)).alias("percent_without_answer"),
    )


def tags_per_question_rows(tagged: DataFrame) -> DataFrame:
    """The same at tag-row grain: rows of the exploded table over the number of questions."""
    groups = tagged.groupBy("TagCountPerPost").agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(F.size("tags_arr")).alias("tag_rows"),
        F.sum(F.col("is_answer") * F.size("tags_arr")).alias("answered_rows"),
    )
    all_questions = groups.agg(F.sum("questions")).scalar()
    return groups.where(F.col("TagCountPerPost").isNotNull()).select(
        "TagCountPerPost",
        F.round(F.col("tag_rows") / all_questions, 4).alias("percent_all"),
        F.round(F.col("answered_rows") / F.col("tag_rows"), 4).alias("percent_answer"),
    )


def tags_per_question_long(per_question: DataFrame) -> DataFrame:
    """Answered and unanswered counts as rows."""
    return per_question.unpivot(
        ["TagCountPerPost"],
        ["num_question_with_answer", "num_without_answer"],
        "outcome",
        "n_questions",
    )


def relative_frequency(frequency: DataFrame) -> DataFrame:
    """Each tag's share of all tag rows."""
    total = frequency.agg(F.sum("tag_frequency")).scalar()
    return frequency.withColumn("rel_frequency", F.col("tag_frequency") / total)


def cumulative_frequency(frequency: DataFrame) -> DataFrame:
    """Running share in order of falling frequency; tags of equal frequency share one value.

    The running sum goes over the different frequencies only. N tag rows have fewer than sqrt(2N) of
    them, so that window stays small however many tags there are, and so does what is broadcast: two numbers for
    each, 1.4 million rows for 10^12 tag rows. Half of all tags may share the lowest frequency; a shuffle would put them in one task.
    """
    total = frequency.agg(F.sum("tag_frequency")).scalar()
    steps = (
        frequency.groupBy("tag_frequency")
        .agg(F.sum("tag_frequency").alias("mass"))
        .select(
            "tag_frequency",
            F.sum("mass").over(Window.orderBy(F.desc("tag_frequency"))).alias("running"),
        )
    )
    return (
        relative_frequency(frequency)
        .join(F.broadcast(steps), "tag_frequency")
        .withColumn("cum_frequency", F.col("running") / total)
        .drop("running")
    )


def head_tags(frequency: DataFrame, cutoff: float) -> DataFrame:
    """The most frequent tags that together cover at most ``cutoff`` of all tag rows."""
    return cumulative_frequency(frequency).where(F.round("cum_frequency", SHARE_PLACES) <= cutoff)


def ranked_tags(frequency: DataFrame, first: int, last: int) -> DataFrame:
    """Tags of rank ``first`` to ``last`` by frequency, ties by name."""
    order = [F.desc("tag_frequency"), F.col("Tag")]
    leaders = frequency.orderBy(*order).limit(last)
    return leaders.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(
        F.col("rank") >= first
    )


def top_tags_by(popularity: DataFrame, n: int, measures: Sequence[str]) -> DataFrame:
    """The ``n`` most frequent tags with the chosen measures."""
    return (
        popularity.select("Tag", "tag_frequency", *measures)
        .orderBy(F.desc("tag_frequency"), "Tag")
        .limit(n)
    )


def yearly_trend(yearly: DataFrame, chosen: DataFrame, years: Sequence[int]) -> DataFrame:
    """Tag by year matrix of frequencies for the chosen tags, one ``y<year>`` column a year.

    ``chosen`` has columns Tag and rank; a tag without a question in a year has null there.
    """
    in_years = yearly.where(F.col("Year").between(min(years), max(years)))
    matrix = (
        in_years.join(chosen.select("Tag", "rank"), "Tag")
        .groupBy("Tag", "rank")
        .pivot("Year", list(years))
        .agg(F.sum("tag_frequency"))
    )
    return matrix.withColumnsRenamed({str(y): f"y{y}" for y in years}).orderBy("rank", "Tag")


def rank_trend(yearly: DataFrame, first: int, last: int, years: Sequence[int]) -> DataFrame:
    """Yearly trend of the tags ranked ``first`` to ``last`` over all years."""
    overall = yearly.groupBy("Tag").agg(F.sum("tag_frequency").alias("tag_frequency"))
    return yearly_trend(yearly, F.broadcast(ranked_tags(overall, first, last)), years)


def keyword_tags(frequency: DataFrame, keyword: str, cutoff: float) -> DataFrame:
    """Head tags whose name contains the keyword in any case."""
    return head_tags(frequency, cutoff).where(F.lower("Tag").contains(keyword.lower()))


def keyword_trend(yearly: DataFrame, keyword: str, cutoff: float, years: Sequence[int]) -> DataFrame:
    """Yearly trend of the head tags that contain the keyword; all of them have rank null."""
    overall = yearly.groupBy("Tag").agg(F.sum("tag_frequency").alias("tag_frequency"))
    chosen = keyword_tags(overall, keyword, cutoff).withColumn("rank", F.lit(None).cast("int"))
    return yearly_trend(yearly, chosen, years).drop("rank").orderBy("Tag")


def keyword_tag_count(yearly: DataFrame, keyword: str, cutoff: float, years: Sequence[int]) -> DataFrame:
    """How many different tags the keyword trend has."""
    trend = keyword_trend(yearly, keyword, cutoff, years)
    return trend.agg(F.count_distinct("Tag").alias("n_tags"))


def null_audit(df: DataFrame) -> DataFrame:
    """Rows, nulls in each column, and rows without any null."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns],
        F.count_if(complete).alias("complete_rows"),
    )
