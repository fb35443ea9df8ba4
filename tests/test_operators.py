"""Tag, post, user and statistics operators on hand-made rows."""

import random

import numpy as np
import pandas as pd
import pytest

from forumscope.operators import features, posts, stats, tags, users
from forumscope.operators.quantiles import group_profile

POSTS = (
    "_Id BIGINT, _PostTypeId INT, _AcceptedAnswerId BIGINT, _CreationDate STRING, _Score INT, "
    "_ViewCount INT, _OwnerUserId BIGINT, _Tags STRING, _AnswerCount INT"
)


@pytest.fixture(scope="module")
def forum(spark):
    rows = [
        (1, 1, 11, "2020-01-01T23:59:00.000", 5, 10, 1, "<a><b>", 1),
        (2, 1, 99, "2020-02-01T00:00:00.000", 1, 20, 1, "<a>", 2),  # accepted id without an answer
        (3, 1, None, "2021-03-01T00:00:00.000", -3, 5, None, "<a><a>", 0),
        (4, 1, None, "not a date", 0, 1, 2, None, None),
        (11, 2, None, "2020-01-02T00:01:00.000", 7, None, 3, None, None),
        (12, 2, None, "2020-01-05T00:00:00.000", 2, None, 2, None, None),
    ]
    return spark.createDataFrame(rows, POSTS)


def test_question_base_and_years(forum):
    got = {r["_Id"]: (r["is_answer"], r["Year"], r["Month"]) for r in posts.question_base(forum).collect()}
    assert got == {1: (1, 2020, 1), 2: (1, 2020, 2), 3: (0, 2021, 3), 4: (0, None, None)}
    assert [r["_Id"] for r in posts.questions_since(forum, 2020).collect()] == [3]


def test_accepted_answer_join(forum):
    row = posts.answer_delay(forum).collect()
    assert [r["QuestionId"] for r in row] == [1]  # the id without an answer is dropped
    assert (row[0]["AnswerDurationSeconds"], row[0]["AnswerDurationDays"]) == (120, 1)
    assert row[0]["AnswerDurationHour"] == pytest.approx(0.0333, abs=1e-4)
    kept = posts.with_accepted_answer(posts.questions(forum), posts.answers(forum), keep_open=True).collect()
    assert sorted((r["_Id"], r["AnswerId"]) for r in kept) == [(1, 11), (2, None), (3, None), (4, None)]


def test_outcome(forum):
    got = {r["_Id"]: r["target"] for r in features.with_outcome(posts.questions(forum)).collect()}
    assert got == {1: "BestAnswered", 2: "BestAnswered", 3: "Unanswered", 4: "Unanswered"}


def test_tag_tables(forum):
    tagged = tags.tags_questions(forum)
    rows = {r["Tag"]: r for r in tags.tag_popularity(tags.tags_distribution(tagged)).collect()}
    assert rows["a"]["tag_frequency"] == 4 and rows["a"]["med_score"] == -1.0
    assert rows["b"]["percent_answer"] == 1.0
    num = {r["TagCountPerPost"]: r for r in tags.tags_per_question(tagged).collect()}
    assert (num[1]["num_question"], num[1]["percent_all"], num[2]["percent_all"]) == (2, 0.5, 0.25)
    by_row = {r["TagCountPerPost"]: r["percent_all"] for r in tags.tags_per_question_rows(tagged).collect()}
    assert by_row == {1: 0.75, 2: 0.5}  # tag rows over questions: may add up to more than one


def test_cumulative_share_keeps_ties(spark):
    frequency = spark.createDataFrame([("p", 3), ("q", 2), ("r", 2), ("s", 1)], "Tag STRING, tag_frequency BIGINT")
    got = {r["Tag"]: r["cum_frequency"] for r in tags.cumulative_frequency(frequency).collect()}
    assert got == {"p": 0.375, "q": 0.875, "r": 0.875, "s": 1.0}
    assert {r["Tag"] for r in tags.head_tags(frequency, 0.875).collect()} == {"p", "q", "r"}
    assert [r["Tag"] for r in tags.ranked_tags(frequency, 2, 3).collect()] == ["q", "r"]


def test_trend_has_null_for_missing_years(spark):
    yearly = spark.createDataFrame(
        [("p", 2019, 5), ("p", 2020, 4), ("q", 2020, 3), ("p", 2030, 9)], "Tag STRING, Year INT, tag_frequency BIGINT"
    )
    got = [tuple(r) for r in tags.rank_trend(yearly, 1, 2, [2019, 2020]).collect()]
    assert got == [("p", 1, 5, 4), ("q", 2, None, 3)]


def test_user_tables(spark, forum):
    people = spark.createDataFrame([(1, 10), (2, None), (4, 7)], "_Id BIGINT, _Reputation INT")
    table = {r["_Id"]: tuple(r)[1:] for r in users.user_post_metric(people, forum, "question_sum_score", "s").collect()}
    assert table == {1: (10, 6), 2: (0, 0), 4: (7, 0)}
    answered = {r["_OwnerUserId"]: tuple(r)[1:] for r in users.user_answered_share(people, forum).collect()}
    assert answered == {1: (2, 2, 1.0, 10), 2: (1, 0, 0.0, None)}
    accepted = [tuple(r) for r in users.user_accepted_answers(people, forum).collect()]
    assert accepted == [(3, 1, None)]  # the owner is no user and keeps a null reputation
    badges = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (9, 2)], "_UserId BIGINT, _Class INT")
    counted = {r["_Id"]: tuple(r)[2:] for r in users.user_badges(people, badges).collect()}
    assert counted == {1: (3, 1, 0, 2), 2: (0, 0, 0, 0), 4: (0, 0, 0, 0)}


def test_exact_quantiles_over_buckets(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.randint(-10, 10), rng.randint(-(10**10), 10**10)])) for _ in range(4001)]
    rows += [("cold", rng.randint(-300_000, 300_000)) for _ in range(20)]
    rows += [("one", 7), ("gap", 1), ("gap", None), (None, 4), (None, 6), ("none", None)]
    df = spark.createDataFrame(rows, "k STRING, v BIGINT")
    got = {r["k"]: r for r in group_profile(df, ["k"], ["v"], (0.25, 0.5, 0.75)).collect()}
    assert set(got) == {"hot", "cold", "one", "gap", None}
    for key, row in got.items():
        values = [v for k, v in rows if k == key and v is not None]
        assert (row["v_n"], row["v_sum"]) == (len(values), sum(values))
        for i, p in enumerate((25, 50, 75)):
            assert row[f"v_q{i}"] == pytest.approx(np.percentile(values, p))


def test_histogram_is_closed_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, -1)] + [(None,)], "v DOUBLE")
    got = [tuple(r) for r in stats.histogram(df, "v", [0, 1, 2, 2.5]).orderBy("bin").collect()]
    assert got == [(1, 0.0, 1.0, 2), (2, 1.0, 2.0, 1), (3, 2.0, 2.5, 0)]


def test_histogram_equals_pandas_cut(spark):
    rng = random.Random(2)
    values = [round(rng.uniform(-1, 11), 1) for _ in range(500)]
    edges = [0, 1, 2.5, 4, 10]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r["n_rows"] for r in stats.histogram(df, "v", edges).orderBy("bin").collect()]
    cut = pd.cut(pd.Series(values), bins=edges, include_lowest=True)
    assert got == cut.value_counts(sort=False).tolist()


def test_correlation_and_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    frame = pd.DataFrame({"x": x, "y": 3 * x + rng.normal(size=200), "c": 1.0})
    frame.loc[:9, "y"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.values], "x DOUBLE, y DOUBLE, c DOUBLE")
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation(df, ["x", "y", "c"]).collect()}
    assert got["x", "y"] == pytest.approx(frame["x"].corr(frame["y"]))
    assert got["x", "c"] is None and got["c", "c"] is None
    line = stats.regression(df, "x", ["y"]).first()
    slope, intercept = np.polyfit(frame["x"][10:], frame["y"][10:], 1)
    assert (line["slope"], line["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    assert line["r2"] == pytest.approx(got["x", "y"] ** 2)


def test_box_statistics(spark):
    values = [*range(1, 12), 100]
    df = spark.createDataFrame([(v,) for v in values], "v INT")
    row = stats.box_statistics(df, ["v"]).first()
    q1, median, q3 = np.percentile(values, (25, 50, 75))
    assert (row["q1"], row["median"], row["q3"]) == (q1, median, q3)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 11.0, 1)


def test_principal_components(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(300, 3)) @ np.array([[2, 1, 0], [0, 1, 1], [0, 0, 0.5]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a DOUBLE, b DOUBLE, c DOUBLE")
    model = features.fit_pca(df, ["a", "b", "c"], 3)
    values, vectors = np.linalg.eigh(np.corrcoef(data.T))
    assert model.variances.tolist() == pytest.approx(values[::-1].tolist())
    loadings = {(r["pc"], r["feature"]): r["loading"] for r in features.pca_loadings(spark, model).collect()}
    first = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
    assert [loadings["PC1", f] for f in "abc"] == pytest.approx(first.tolist())
    ratios = [r["cum_total"] for r in features.pca_variance(spark, model).orderBy("pc").collect()]
    assert ratios[-1] == pytest.approx(1.0)
