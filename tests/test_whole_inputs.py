"""The views hold all of the given tables: counts taken straight from the raw files."""

import pytest
from pyspark.sql import functions as F

from compare import connect
from conftest import SMALL
from forumscope.functions.tags import tag_list
from forumscope.functions.timing import delay_columns, moment
from forumscope.operators import features
from forumscope.schemas import DUMP_TABLES
from forumscope.sources import dumps


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def one(duck, sql):
    return duck.execute(sql).fetchone()[0]


def test_bodies_hold_every_character(community, duck):
    plain = F.regexp_replace("_Body", "</?(p|pre|code)>", "")
    kept = community.texts().agg(F.sum(F.length(plain)).alias("n"), F.sum(F.length("_Title")).alias("t")).first()
    assert kept["n"] == one(duck, "SELECT sum(length(regexp_replace(text, '</?(p|pre|code)>', '', 'g'))) FROM documents")
    assert kept["t"] == one(duck, "SELECT sum(length(split_part(text, chr(10), 1))) FROM documents")


def test_all_tags_badges_and_terms(community, duck):
    pairs = community.questions(with_tags=True).select(F.sum(F.size(tag_list(F.col("_Tags"))))).first()[0]
    assert pairs == one(
        duck,
        "SELECT count(*) FROM (SELECT DISTINCT l_orderkey, unnest([replace(p_name, ' ', '-')] || "
        "CASE WHEN l_linenumber = 1 THEN [lower(p_type)] ELSE [] END) FROM lineitem JOIN part ON l_partkey = p_partkey)",
    )
    assert community.badges().count() == one(duck, "SELECT count(*) FROM orders")
    assert community.lexicon().count() == one(
        duck,
        r"SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS t "
        "FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)",
    )


def test_samples_do_not_follow_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("_Id"), F.lit(2020).alias("Year"))
    few = features.sample_by_year(rows.coalesce(2), [2020], 0.1, 1).collect()
    many = features.sample_by_year(rows.repartition(7), [2020], 0.1, 1).collect()
    assert sorted(few) == sorted(many) and 400 < len(few) < 600


def test_delays_do_not_follow_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.createDataFrame([("2020-03-08T01:30:00.000", "2020-03-08T03:30:00.000")], "q STRING, a STRING")
        columns = delay_columns(moment(F.col("q")), moment(F.col("a")))
        assert row.select(columns["AnswerDurationHour"].alias("h")).first()["h"] == 2.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def xml_file(path, body):
    path.mkdir()
    (path / "Tags.xml").write_text(body)
    return str(path)


WHOLE = '<row Id="1" TagName="a" Count="3" />\n<row Id="2" TagName="b" Count="4" />\n'


def test_xml_lines(spark, tmp_path):
    head = '<?xml version="1.0" encoding="utf-8"?>\n<tags>\n'
    good = xml_file(tmp_path / "good", head + WHOLE + "</tags>\n")
    assert sorted(r["_Id"] for r in dumps.read_xml_dump(spark, good, "tags").collect()) == [1, 2]
    spanning = xml_file(tmp_path / "spanning", head + WHOLE + '<row Id="3"\n TagName="c" Count="5" />\n</tags>\n')
    for splittable in (True, False):
        rows = dumps.read_xml_dump(spark, spanning, "tags", splittable).select("_Id", "_TagName", "_Count").collect()
        assert sorted(map(tuple, rows)) == [(1, "a", 3), (2, "b", 4), (3, "c", 5)]


def test_xml_elements_anywhere(spark, tmp_path):
    odd = (
        "<rowset><!-- no lines --><row Id='1' TagName='a \"/> b' Count='3'/><row Id=\"2\" TagName=\"it's\" ></row>"
        '<row\n\tId="3"\r\n TagName="&lt;row Id=&quot;9&quot; /&gt;" Count = "5"\n/></rowset>'
    )
    rows = dumps.read_xml_dump(spark, xml_file(tmp_path / "odd", odd), "tags").select("_Id", "_TagName", "_Count").collect()
    assert sorted(map(tuple, rows)) == [(1, 'a "/> b', 3), (2, "it's", None), (3, '<row Id="9" />', 5)]
    assert dumps.read_xml_dump(spark, xml_file(tmp_path / "empty", ""), "tags").count() == 0
    assert dumps.read_xml_dump(spark, xml_file(tmp_path / "none", "<tags>\n</tags>\n"), "tags").count() == 0


@pytest.mark.parametrize("bad", ['<row Id="3" TagName="c"\n</tags>', '<row Id="3" TagName="c', '<row Id="three" />'])
def test_xml_broken_elements(spark, tmp_path, bad):
    path = xml_file(tmp_path / "bad", "<tags>\n" + WHOLE + bad)
    with pytest.raises(Exception, match="not a whole element"):
        dumps.read_xml_dump(spark, path, "tags").collect()


def test_xml_over_lines_is_split(spark, tmp_path):
    """Every element spans three lines, in tasks of 30 KB whose borders fall anywhere in them."""
    body = "".join(f'<row Id="{i}"\n TagName="t{i}&#xA;x"\n Count="{i % 9}" />\n' for i in range(8_000))
    path = xml_file(tmp_path / "long", "<tags>\n" + body + "</tags>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30001")
    try:
        df = dumps.read_xml_dump(spark, path, "tags")
        assert df.rdd.getNumPartitions() > 8
        made = df.selectExpr("count(*)", "count(DISTINCT _Id)", "count_if(_TagName = concat('t', _Id, '\\nx'))", "sum(_Count)")
        assert tuple(made.first()) == (8_000, 8_000, 8_000, sum(i % 9 for i in range(8_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("codec", ["gzip", "bzip2"])
def test_compressed_posts_with_text(spark, community, tmp_path, codec):
    wanted = community.texts().select("_Id", "_PostTypeId", F.translate("_Title", "\n", " ").alias("_Title"), "_Tags")
    path = str(tmp_path / codec)
    wanted.write.format("xml").option("rowTag", "row").option("rootTag", "posts").option("compression", codec).save(path)
    read = dumps.read_xml_dump(spark, path, "posts").select(*wanted.columns)
    assert read.exceptAll(wanted).count() == 0 and read.count() == wanted.count()
    assert set(DUMP_TABLES) == {"tags", "postlinks", "badges", "users", "posts"}
