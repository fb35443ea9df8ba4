"""Every query with a SQL counterpart against DuckDB; the others by their invariants."""

import pytest

from compare import connect, differences
from conftest import SMALL
from forumscope.plans.catalog import run
from forumscope.plans.oracle import QUERIES, statements

SQL = statements()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    assert differences(run(name, spark, SMALL), duck, SQL[name]) is None


def test_tag_clusters(spark, duck):
    tags = {r[0]: r[1] for r in duck.execute(SQL["tag_rel_frequency"]).fetchall()}
    clustered = run("tag_kmeans", spark, SMALL).collect()
    assert {r["Tag"]: r["tag_frequency"] for r in clustered} == tags
    assert {r["cluster"] for r in clustered} <= set(range(20))
    exported = {(r["Tag"], r["n"]) for r in run("cluster_word_freq_export", spark, SMALL).collect()}
    assert exported == set(tags.items())


def test_every_tag_has_an_exemplar(spark, duck):
    tags = {r[0] for r in duck.execute(SQL["tag_rel_frequency"]).fetchall()}
    found = {r["Tag"]: r["exemplar"] for r in run("tag_affinity", spark, SMALL).collect()}
    assert set(found) == tags
    assert all(found[leader] == leader for leader in found.values())


def test_samples(spark):
    sample = run("stratified_sample", spark, SMALL).collect()
    assert 5 <= len(sample) <= 40 and run("stratified_sample", spark, SMALL).collect() == sample
