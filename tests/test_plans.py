"""Shapes of plans, and the XML reader."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumscope.operators import features, joins, posts, stats, tags, text, users
from forumscope.plans.catalog import JOBS, run
from forumscope.plans.oracle import QUERIES, statements
from forumscope.sources import dumps

from conftest import SMALL

HOT = ("top_tags", "question_metrics", "user_answered_share", "answer_delay", "tags_distribution", "corr_features", "tag_tfidf")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HOT)
def test_no_python_stage(spark, name):
    plan = plan_of(run(name, spark, SMALL))
    assert "EvalPython" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def stored_posts(spark, community, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("posts") / "table")
    dumps.write_parquet(community.posts(with_tags=True), path)
    return dumps.read_parquet(spark, path)


def test_filters_reach_the_scan(stored_posts):
    plan = plan_of(posts.questions_since(stored_posts, 1998).select("_Id"))
    assert "EqualTo(_PostTypeId,1)" in plan and "GreaterThanOrEqual(_Cr" in plan
    assert "_Tags" not in plan


def test_all_owner_metrics_need_one_scan(stored_posts, community):
    names = ["answer_sum_score", "question_avg_score", "question_sum_viewcount", "question_asked"]
    plan = plan_of(users.owner_totals(stored_posts, names))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_frequency_needs_one_shuffle(stored_posts):
    plan = plan_of(tags.tag_frequency(tags.tags_distribution(tags.tags_questions(stored_posts))))
    assert plan.count("Exchange") == 1 and "partial_count" in plan


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_bodies_are_read_once(spark, community, tmp_path, broadcast_bytes, monkeypatch):
    texts = community.texts()
    texts.write.parquet(f"{tmp_path}/texts")
    community.lexicon().write.parquet(f"{tmp_path}/lexicon")
    texts, lexicon = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("texts", "lexicon"))
    monkeypatch.setattr(text, "BROADCAST_BYTES", broadcast_bytes)
    for made in (text.sentiment(texts, lexicon, broadcast_bytes), text.question_metrics(texts, lexicon, ["_Score"])):
        plan = plan_of(made)
        assert sum("FileScan" in line and "/texts" in line for line in plan.splitlines()) == 1
        assert "SortMergeJoin" not in plan or broadcast_bytes == 0


def test_components_need_one_aggregation(spark):
    rows = spark.range(1000).selectExpr("id AS _Id", "id * 1.0D AS a", "sin(id) AS b", "3.0D AS c")
    model = features.fit_pca(rows, ["a", "b", "c"], 2)
    data = np.array([[r["a"], r["b"]] for r in rows.collect()])
    r = np.corrcoef(data.T)[0, 1]
    assert model.variances.tolist() == pytest.approx([1 + abs(r), 1 - abs(r), 0.0])
    assert model.loadings[:, 2].tolist() == [0.0, 0.0]  # a constant column
    plan = plan_of(features.pca_scores(rows, model, ["_Id"]))
    assert "Exchange" not in plan and "Python" not in plan
    scores = np.array([[r["PC1"], r["PC2"]] for r in features.pca_scores(rows, model, ["_Id"]).collect()])
    assert np.cov(scores.T).diagonal().tolist() == pytest.approx(model.variances[:2].tolist())


def test_sample_is_exact_and_free_of_layout(spark):
    rows = spark.range(5000).withColumnRenamed("id", "_Id")
    first = features.least_hashed(rows, 1000, 1)
    assert "TakeOrderedAndProject" in plan_of(first)
    ids = [r["_Id"] for r in first.collect()]
    assert len(ids) == 1000 and ids == [r["_Id"] for r in features.least_hashed(rows.repartition(13), 1000, 1).collect()]
    assert features.least_hashed(rows.limit(7), 1000, 1).count() == 7 and features.least_hashed(rows.limit(0), 5, 1).count() == 0


def test_broadcasts_are_measured_in_memory(spark):
    rows = spark.range(1000).selectExpr("id", "repeat('x', 100) AS s", "array_repeat(struct(id, 1.0D AS w), 50) AS a", "array('yy', 'z') AS t")
    assert joins.fits_broadcast(rows.select("id"), 60_000) and not joins.fits_broadcast(rows.select("id"), 50_000)
    assert not joins.fits_broadcast(rows.select("s"), 150_000)
    assert not joins.fits_broadcast(rows.select("id", "a"), 1_500_000) and joins.fits_broadcast(rows.select("id", "a"), 2_500_000)
    assert joins.fits_broadcast(rows.select("t"), 200_000) and not joins.fits_broadcast(rows.select("t"), 100_000)


def test_xml_lines_are_split(spark, tmp_path):
    path = tmp_path / "Tags.xml"
    lines = [f'  <row Id="{i}" TagName="c&lt;{i}&gt; &amp;&#xA;x" Count="{i % 7}" />' for i in range(20_000)]
    path.write_text('<?xml version="1.0"?>\n<tags>\n' + "\n".join(lines) + "\n</tags>\n")
    small = "200000"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    try:
        df = dumps.read_xml_dump(spark, str(path), "tags")
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 20_000
        assert df.where("_TagName = concat('c<', _Id, '> &\\nx')").count() == 20_000
        assert dumps.read_xml_dump(spark, str(path), "tags", splittable=False).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hot_keys_are_split_and_others_are_not_repeated(spark):
    """One key and the null key hold a third of the rows each; the lookup is too large to broadcast."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id) END").alias("k")
    facts = spark.range(90_000).repartition(6).select("id", key)
    lookup = spark.range(0, 100_000, 3).selectExpr("concat('k', id + 1) AS k", "id AS v").unionByName(
        spark.createDataFrame([("hot", -1)], "k string, v bigint")
    )
    hot = joins.hot_keys(facts, "k")
    assert "hot" in hot and len(hot) <= 1 / joins.HOT_SHARE
    repeated = joins.repeat_hot(lookup, "k", ["hot"], 16)
    assert repeated.count() == lookup.count() + 15
    wanted = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        for how, rows in (("inner", 60_000), ("left", 90_000)):
            made = joins.join_lookup(facts, lookup, "k", F.col("id"), broadcast_bytes=0, salts=64, how=how)
            sizes = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in sizes) == rows and max(r["count"] for r in sizes) < rows / 5
            plain = facts.join(lookup, "k", how).select("id", "k", "v")
            assert made.select("id", "k", "v").exceptAll(plain).count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert joins.join_lookup(facts.limit(0), lookup, "k", F.col("id"), broadcast_bytes=0).count() == 0


def test_histogram_of_nothing(spark):
    none = spark.createDataFrame([], "v double")
    for start, edge in ((None, 0.0), (-1.0, -1.0)):
        rows = stats.histogram(none, "v", stats.even_edges(none, "v", 3, start)).orderBy("bin").collect()
        assert [tuple(r) for r in rows] == [(i, edge, edge, 0) for i in (1, 2, 3)]


def test_every_statement_has_a_query():
    assert set(QUERIES) <= set(JOBS)
    assert all(sql for sql in statements().values())
