"""Every registered query: a name, and a job over the whole given tables.

Queries round doubles so that results compare across engines; operators never round them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from forumscope.functions.tags import tag_words
from forumscope.functions.timing import moment
from forumscope.operators import affinity, clusters, features, posts, stats, tags, text, users
from forumscope.schemas import DUMP_TABLES
from forumscope.session import new_folder, shared_folder
from forumscope.sources import dumps
from forumscope.sources.fixtures import Community

Query = Callable[[Community], DataFrame]

PLACES = 6
YEARS = tuple(range(1995, 2002))
TEXT_YEARS = tuple(range(2012, 2022))
KEYWORD = "Rod"
EDIT_DISTANCE = 2
SEED = 1
KMEANS_STEPS = 30

# Outlier caps of the user tables.
CAPS = {
    "count_all_badges": 5000,
    "answer_sum_score": 150_000,
    "answer_avg_score": 3000,
    "count_accepted_answer": 15_000,
    "question_sum_score": 20_000,
    "question_avg_score": 3000,
    "sum_viewcount": 20_000_000,
    "question_asked": 1500,
}

# Edges of the published histograms.
HOURS = list(range(25))
MINUTES = list(range(61))
SECONDS = [0, 1, *range(6, 61, 6)]
EASE = [i * 10 for i in range(11)]
GRADE = [i * 19 / 9 for i in range(10)]
COLEMAN = list(range(1, 21))
SENTIMENT = [i / 10 for i in range(-10, 0)] + [-0.05, 0.05] + [i / 10 for i in range(1, 11)]

DELAYS = ("AnswerDurationSeconds", "AnswerDurationMinute", "AnswerDurationHour", "AnswerDurationDays")
SLOW = (
    "code_percentage",
    "cos_sim_post_title",
    "cos_sim_title_tag",
    "AnswerDurationMinute",
    "_Score",
    "_ViewCount",
    "Flesch_reading_ease",
    "sentiment",
)


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles to some places; the finer rounding first takes binary noise off decimal ties."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.round(c, 10), places) for c in doubles}) if doubles else df


def tagged(c: Community) -> DataFrame:
    return tags.tags_questions(c.posts(with_tags=True))


def distribution(c: Community) -> DataFrame:
    return tags.tags_distribution(tagged(c))


def frequency(c: Community) -> DataFrame:
    return tags.tag_frequency(distribution(c))


def yearly(c: Community) -> DataFrame:
    return tags.tag_frequency(distribution(c), "Year")


def popularity(c: Community) -> DataFrame:
    return tags.tag_popularity(distribution(c))


def per_question(c: Community) -> DataFrame:
    return tags.tags_per_question(tagged(c))


def delays(c: Community, with_tags: bool = False) -> DataFrame:
    asked = c.posts(with_tags)
    return posts.answer_delay(asked if with_tags else asked.withColumn("_Tags", F.lit(None).cast("string")))


def lexicon(c: Community) -> DataFrame:
    """The word valences, written once as the input table that they stand for."""
    shared_folder(c.spark)
    return c.lexicon().checkpoint()


def metrics(c: Community, *carry: str) -> DataFrame:
    return text.question_metrics(c.texts(), lexicon(c), carry)


def stored_metric(c: Community, column: str) -> DataFrame:
    """One metric, written once: a histogram reads it for its edges and again for its bins."""
    shared_folder(c.spark)
    table = text.question_metrics(c.texts(), lexicon(c) if column == "sentiment" else None)
    return rounded(table.select(column), 9).checkpoint()


def metrics_with_delay(c: Community) -> DataFrame:
    asked = metrics(c, "_AcceptedAnswerId", "_CreationDate", "_Score", "_ViewCount", "_AnswerCount")
    joined = posts.with_accepted_answer(asked, posts.answers(c.text_answers()), keep_open=True)
    return joined.drop("AnswerId", "AcceptedAnswerCreationDate", "_CreationDate")


def feature_table(c: Community) -> DataFrame:
    measured = metrics(c, "_AcceptedAnswerId", *features.COUNTERS)
    return features.question_features(measured)


def stored_features(c: Community) -> DataFrame:
    """The feature table, written once: fitting reads it several times."""
    shared_folder(c.spark)
    return feature_table(c).checkpoint()


def tag_names(c: Community) -> DataFrame:
    return frequency(c).select("Tag")


def fitted_pca(table: DataFrame) -> features.Components:
    return features.fit_pca(table, features.FEATURES, len(features.FEATURES))


FEATURES9 = (*features.FEATURES, "_Score", "target_cat")


def feature_table9(c: Community) -> DataFrame:
    return features.with_label_index(stored_features(c), "target", "target_cat")


# ---- sources and sinks


def ingest(table: str) -> Query:
    """Write a dump table as XML, read it back with the declared schema."""

    def query(c: Community) -> DataFrame:
        rows = c.dump(table)
        path = new_folder(c.spark, f"dump-{table}")
        dumps.write_xml_dump(rows, path, table)
        return dumps.read_xml_dump(c.spark, path, table).select(*rows.columns)

    return query


def parquet_roundtrip(c: Community) -> DataFrame:
    path = new_folder(c.spark, "top-tags")
    dumps.write_parquet(rounded(popularity(c)), path)
    return dumps.read_parquet(c.spark, path)


def parquet_multi_path(c: Community) -> DataFrame:
    columns = ["_Id", "_PostTypeId", "_CreationDate", "_Score"]
    paths = [new_folder(c.spark, "questions"), new_folder(c.spark, "answers")]
    dumps.write_parquet(c.questions().select(*columns), paths[0])
    dumps.write_parquet(c.answers().select(*columns), paths[1])
    return dumps.read_parquet(c.spark, *paths)


def parquet_overwrite(c: Community) -> DataFrame:
    path = new_folder(c.spark, "questions")
    asked = c.questions().select("_Id", "_PostTypeId", "_AcceptedAnswerId", "_Score")
    dumps.write_parquet(asked, path)
    dumps.write_parquet(posts.accepted_questions(asked), path, overwrite=True)
    return dumps.read_parquet(c.spark, path)


def csv_roundtrip(c: Community) -> DataFrame:
    table = rounded(tags.head_tags(frequency(c), 0.9))
    path = new_folder(c.spark, "top-tags-90")
    dumps.write_csv(table, path)
    return dumps.read_csv(c.spark, path, table.schema)


# ---- tables of users


def user_tables() -> dict[str, tuple[Query, tuple[str, ...], dict[str, int]]]:
    """For each user table: its query, its metrics, and the cap applied before statistics."""

    def post_metric(metric: str, output: str) -> Query:
        return lambda c: users.user_post_metric(c.users(), c.posts(), metric, output)

    badge_columns = ("count_all_badges", "count_gold", "count_silver", "count_bronze")
    return {
        "badges": (
            lambda c: users.user_badges(c.users(), c.badges()),
            badge_columns,
            {"count_all_badges": CAPS["count_all_badges"]},
        ),
        "answer_score_sum": (
            post_metric("answer_sum_score", "sum_score"),
            ("sum_score",),
            {"sum_score": CAPS["answer_sum_score"]},
        ),
        "answer_score_avg": (
            post_metric("answer_avg_score", "avg_score"),
            ("avg_score",),
            {"avg_score": CAPS["answer_avg_score"]},
        ),
        "accepted_answers": (
            lambda c: users.user_accepted_answers(c.users(), c.posts()),
            ("count_accepted_answer",),
            {"count_accepted_answer": CAPS["count_accepted_answer"]},
        ),
        "question_score_sum": (
            post_metric("question_sum_score", "sum_score"),
            ("sum_score",),
            {"sum_score": CAPS["question_sum_score"]},
        ),
        "question_score_avg": (
            post_metric("question_avg_score", "avg_score"),
            ("avg_score",),
            {"avg_score": CAPS["question_avg_score"]},
        ),
        "question_views": (
            post_metric("question_sum_viewcount", "sum_viewcount"),
            ("sum_viewcount",),
            {"sum_viewcount": CAPS["sum_viewcount"]},
        ),
        "answered_share": (
            lambda c: users.user_answered_share(c.users(), c.posts()),
            ("question_asked", "question_answered", "percent_answered"),
            {"question_asked": CAPS["question_asked"]},
        ),
    }


def user_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, (table, columns, caps) in user_tables().items():
        found[f"user_{name}"] = table
        found[f"corr_user_{name}"] = lambda c, t=table, m=columns, k=caps: stats.correlation(
            users.without_outliers(t(c), k), ["_Reputation", *m]
        )
        found[f"regr_user_{name}"] = lambda c, t=table, m=columns, k=caps: stats.regression(
            users.without_outliers(t(c), k), "_Reputation", m
        )
    return found


def top_users_by_metric(c: Community) -> DataFrame:
    """Ten leading users in each post metric; one aggregation of the posts feeds all lists."""
    names = ["answer_sum_score", "answer_avg_score", "question_sum_score", "question_avg_score", "question_sum_viewcount"]
    table = users.users_with(c.users(), users.owner_totals(c.posts(), names), "_OwnerUserId")
    values = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    return users.top_of_each(table.select("_Id", "_Reputation", values), 10)


BADGE_COLUMNS = ("_Reputation", "count_all_badges", "count_gold", "count_silver", "count_bronze")


def badge_table(c: Community) -> DataFrame:
    return users.user_badges(c.users(), c.badges())


# ---- histograms


def day_edges(df: DataFrame) -> list[float]:
    """Days up to seven, and one bin for all longer delays if there are any."""
    longest = df.agg(F.max("AnswerDurationDays")).first()[0]
    return [*range(8), longest] if longest is not None and longest > 7 else list(range(8))


def histogram_queries() -> dict[str, Query]:
    def delay(column: str, edges) -> Query:
        return lambda c: stats.histogram(delays(c), column, edges)

    def metric(column: str, edges) -> Query:
        return lambda c: stats.histogram(stored_metric(c, column), column, edges)

    def spread(column: str, bins: int, start: float | None = None) -> Query:
        def query(c: Community) -> DataFrame:
            table = stored_metric(c, column)
            return stats.histogram(table, column, stats.even_edges(table, column, bins, start))

        return query

    def days(c: Community) -> DataFrame:
        shared_folder(c.spark)
        table = delays(c).select("AnswerDurationDays").checkpoint()
        return stats.histogram(table, "AnswerDurationDays", day_edges(table))

    return {
        "hist_delay_hours": delay("AnswerDurationHour", HOURS),
        "hist_delay_minutes": delay("AnswerDurationMinute", MINUTES),
        "hist_delay_days": days,
        "hist_delay_seconds": delay("AnswerDurationSeconds", SECONDS),
        "hist_code_share": spread("code_percentage", 10, 0.0),
        "hist_cos_post_title": spread("cos_sim_post_title", 9),
        "hist_cos_title_tag": spread("cos_sim_title_tag", 9),
        "hist_ease": metric("Flesch_reading_ease", EASE),
        "hist_grade": metric("Flesch_Kincard_Grade", GRADE),
        "hist_coleman": metric("Coleman_Liau_index", COLEMAN),
        "hist_sentiment": metric("sentiment", SENTIMENT),
    }


# ---- tag clusters


def tag_clusters(c: Community) -> DataFrame:
    return clusters.tag_clusters(frequency(c), max_iterations=KMEANS_STEPS)


def cluster_word_freq_export(c: Community) -> DataFrame:
    path = new_folder(c.spark, "cluster-words")
    words = clusters.cluster_words(tag_clusters(c))
    dumps.write_csv(words, path, ("cluster",))
    return dumps.read_csv(c.spark, path, words.select("Tag", "n", "cluster").schema)


def kmeans_sizes_export(c: Community) -> DataFrame:
    path = new_folder(c.spark, "cluster-sizes")
    sizes = clusters.cluster_sizes(tag_clusters(c))
    dumps.write_csv(sizes, path)
    return dumps.read_csv(c.spark, path, sizes.schema)


def similar_pairs(c: Community) -> tuple[DataFrame, DataFrame]:
    shared_folder(c.spark)
    names = tag_names(c).checkpoint()
    return names, affinity.similar_tags(names, EDIT_DISTANCE)


def tag_affinity(c: Community) -> DataFrame:
    names, pairs = similar_pairs(c)
    return affinity.affinity_clusters(names, affinity.name_similarity(pairs), -(EDIT_DISTANCE + 1.0))


def tag_affinity_euclid(c: Community) -> DataFrame:
    names, pairs = similar_pairs(c)
    pairs = pairs.checkpoint()
    edges = affinity.profile_similarity(names, pairs, EDIT_DISTANCE)
    return affinity.affinity_clusters(names, edges, affinity.profile_halves(names, pairs, EDIT_DISTANCE))


def saved_pca(c: Community, table: DataFrame) -> features.Components:
    """A model, scales included, that was saved and loaded again."""
    path = new_folder(c.spark, "pca")
    features.save_components(c.spark, fitted_pca(table), path)
    return features.load_components(c.spark, path)


def pca_scores(c: Community, saved: bool = False) -> DataFrame:
    table = stored_features(c)
    model = saved_pca(c, table) if saved else fitted_pca(table)
    return features.pca_scores(table, model, ["_Id", "target"])


def score_moments(c: Community) -> DataFrame:
    """Mean and variance of every component's scores, and its largest correlation with another one."""
    table = pca_scores(c)
    names = [f"PC{i + 1}" for i in range(len(features.FEATURES))]
    of = features.moments(table, names)
    others = abs(of.correlations - np.diag(of.correlations.diagonal())).max(axis=1)
    rows = list(zip(names, of.means.tolist(), (of.deviations**2).tolist(), others.tolist()))
    return c.spark.createDataFrame(rows, "pc STRING, mean DOUBLE, variance DOUBLE, most_shared DOUBLE")


def stratified_sample(c: Community) -> DataFrame:
    dated = c.texts().select("_Id", "_Score", F.year(moment(F.col("_CreationDate"))).alias("Year"))
    return features.sample_by_year(dated, TEXT_YEARS, 0.1, SEED)


JOBS: dict[str, Query] = {
    **{f"ingest_{table}": ingest(table) for table in DUMP_TABLES},
    "parquet_roundtrip": parquet_roundtrip,
    "parquet_multi_path": parquet_multi_path,
    "parquet_overwrite": parquet_overwrite,
    "csv_roundtrip": csv_roundtrip,
    # posts
    "question_base": lambda c: posts.question_base(c.posts(with_tags=True)),
    "answer_base": lambda c: posts.answers(c.posts()),
    "accepted_questions": lambda c: posts.accepted_questions(c.posts()).select("_Id", "_AcceptedAnswerId", "_Score"),
    "questions_since_year": lambda c: posts.questions_since(c.posts(), 1998).select("_Id", "_CreationDate", "_Score"),
    "question_outcome": lambda c: features.with_outcome(c.texts()).select("_Id", "target"),
    "outcome_counts": lambda c: features.outcome_counts(c.texts()),
    "outcome_index": lambda c: features.with_label_index(
        features.with_outcome(c.texts()).select("_Id", "target"), "target", "target_cat"
    ),
    "post_counts": lambda c: posts.post_counts(c.posts()),
    "questions_per_year": lambda c: posts.questions_per_year(c.posts()),
    "answer_delay": lambda c: delays(c, with_tags=True),
    "question_at_delay": lambda c: posts.question_at_delay(delays(c), 5).drop("_Tags"),
    # tags
    "tag_text": lambda c: c.questions(with_tags=True).select("_Id", tag_words(F.col("_Tags")).alias("tag_text")),
    "tags_questions": lambda c: tagged(c).withColumn("tags_arr", F.array_join("tags_arr", ",")),
    "tags_distribution": distribution,
    "top_tags": popularity,
    "top_tags_year": lambda c: tags.tag_popularity(distribution(c), "Year"),
    "tags_num": per_question,
    "tags_num_rows": lambda c: tags.tags_per_question_rows(tagged(c)),
    "tags_num_long": lambda c: tags.tags_per_question_long(per_question(c)),
    "tag_rel_frequency": lambda c: tags.relative_frequency(frequency(c)),
    "tag_cum_frequency": lambda c: tags.cumulative_frequency(frequency(c)),
    "top_tags_80": lambda c: tags.head_tags(frequency(c), 0.80),
    "top_tags_85": lambda c: tags.head_tags(frequency(c), 0.85),
    "top_tags_90": lambda c: tags.head_tags(frequency(c), 0.90),
    "tag_rank_slices": lambda c: tags.ranked_tags(frequency(c), 1, 60),
    "tag_trend_1_20": lambda c: tags.rank_trend(yearly(c), 1, 20, YEARS),
    "tag_trend_21_40": lambda c: tags.rank_trend(yearly(c), 21, 40, YEARS),
    "tag_trend_41_60": lambda c: tags.rank_trend(yearly(c), 41, 60, YEARS),
    "tag_trend_keyword": lambda c: tags.keyword_trend(yearly(c), KEYWORD, 0.90, YEARS),
    "tag_trend_keyword_n": lambda c: tags.keyword_tag_count(yearly(c), KEYWORD, 0.90, YEARS),
    "tag_null_audit": lambda c: tags.null_audit(posts.question_base(c.posts(with_tags=True))),
    "top_tags_response": lambda c: tags.tag_response(delays(c, with_tags=True)),
    "top20_tags_answered": lambda c: tags.top_tags_by(popularity(c), 20, ["percent_answer"]),
    "top20_tags_wait": lambda c: tags.top_tags_by(
        tags.tag_response(delays(c, with_tags=True)), 20, ["med_AnswerDurationHour", "avg_AnswerDurationHour"]
    ),
    # users
    **user_queries(),
    "user_metric_trimmed": lambda c: users.without_outliers(badge_table(c), {"count_all_badges": 6}),
    "user_badges_box": lambda c: stats.box_statistics(badge_table(c), BADGE_COLUMNS),
    "user_badges_hist": lambda c: stats.equal_width_histogram(badge_table(c), BADGE_COLUMNS, 10),
    "top_users_by_metric": top_users_by_metric,
    # text
    "text_clean": lambda c: text.cleaned_text(c.markup()),
    "text_clean_with_code": lambda c: text.cleaned_text(c.markup(), keep_code=True),
    "text_counts": lambda c: text.text_counts(c.texts()),
    "readability": lambda c: text.readability(c.texts()),
    "code_share": lambda c: text.code_shares(c.texts()),
    "cosine_post_title": lambda c: text.title_cosines(c.texts(), "post"),
    "cosine_tags_title": lambda c: text.title_cosines(c.texts(), "tags"),
    "sentiment_lexicon": lambda c: text.sentiment(c.texts(), lexicon(c)),
    "question_metrics": metrics,
    "question_metrics_delay": metrics_with_delay,
    "metric_ranges": lambda c: stats.column_ranges(metrics_with_delay(c), [*text.METRICS, *DELAYS]),
    "positive_share": lambda c: stats.share_at_least(
        rounded(metrics_with_delay(c), 9), "sentiment", 0.5, [*text.METRICS, *DELAYS]
    ),
    **histogram_queries(),
    "corr_slow_questions": lambda c: stats.correlation(
        metrics_with_delay(c).where(F.col("AnswerDurationDays") > 1), SLOW
    ),
    # features
    "question_features": feature_table,
    "corr_features": lambda c: stats.correlation(feature_table(c), features.FEATURES),
    "corr_features9": lambda c: stats.correlation(feature_table9(c), FEATURES9),
    "pca_correlation": lambda c: features.correlation_of_components(c.spark, fitted_pca(feature_table(c))),
    "features_scaled": lambda c: features.scaled_columns(stored_features(c), features.FEATURES, ["_Id"]),
    "pca_scores": pca_scores,
    "pca_scores_sample": lambda c: features.least_hashed(pca_scores(c), 1000, SEED),
    "pca_saved_scores": lambda c: pca_scores(c, saved=True),
    "pca_score_moments": score_moments,
    "pca_variance": lambda c: features.pca_variance(c.spark, fitted_pca(feature_table(c))),
    "pca_loadings": lambda c: features.pca_loadings(c.spark, fitted_pca(feature_table(c))),
    "pca3_variance": lambda c: features.pca_variance(c.spark, features.fit_pca(feature_table9(c), FEATURES9, 3)),
    "pca3_loadings": lambda c: features.pca_loadings(c.spark, features.fit_pca(feature_table9(c), FEATURES9, 3)),
    "pca_model_roundtrip": lambda c: features.pca_loadings(c.spark, saved_pca(c, feature_table(c))),
    "stratified_sample": stratified_sample,
    # tag clusters
    "tag_tfidf": lambda c: clusters.tag_tfidf(frequency(c)),
    "tag_kmeans": tag_clusters,
    "kmeans_misplaced": lambda c: clusters.misplaced_tags(tag_clusters(c)),
    "kmeans_sizes": lambda c: clusters.cluster_sizes(tag_clusters(c)),
    "cluster_word_freq": lambda c: clusters.cluster_words(tag_clusters(c)),
    "cluster_word_freq_export": cluster_word_freq_export,
    "kmeans_sizes_export": kmeans_sizes_export,
    "tag_levenshtein": lambda c: affinity.similar_tags(tag_names(c), EDIT_DISTANCE),
    "tag_affinity": tag_affinity,
    "tag_affinity_euclid": tag_affinity_euclid,
    "tag_affinity_members": lambda c: affinity.cluster_members(tag_affinity(c)),
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(JOBS[name](Community(spark, folder)))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, n=name: run(n, spark, folder)) for name in JOBS}
