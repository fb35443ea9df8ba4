"""A written XML dump is small: packed files of bounded rows, with nothing left of its shuffles."""

import os

from pyspark.sql import functions as F

from forumscope import session
from forumscope.sources import dumps


def size(folder, ending):
    return sum(os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder) if name.endswith(ending))


def test_dumps_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dumps, "FILE_ROWS", 300)
    names = F.format_string("tag <%d> & \"more\"\nof it", F.col("id")).alias("_TagName")
    rows = spark.range(2000).select(F.col("id").alias("_Id"), names, F.when(F.col("id") % 3 == 0, F.col("id")).cast("int").alias("_Count"))
    rows = rows.groupBy("_Id").agg(F.max("_TagName").alias("_TagName"), F.max("_Count").alias("_Count")).coalesce(2)
    cleaned = []
    real = session.spent_shuffles_go
    monkeypatch.setattr(dumps, "spent_shuffles_go", lambda given: cleaned.append(given) or real(given))
    before = spark.conf.get(session.CLEANUP, "false")
    dumps.write_xml_dump(rows, f"{tmp_path}/packed", "tags")
    assert cleaned and spark.conf.get(session.CLEANUP) == before
    dumps.write_xml_dump(rows, f"{tmp_path}/plain", "tags", "none")
    assert sum(name.endswith(".xml.gz") for name in os.listdir(f"{tmp_path}/packed")) >= 7
    assert 0 < size(f"{tmp_path}/packed", ".gz") < size(f"{tmp_path}/plain", ".xml") / 4
    for folder in ("packed", "plain"):
        read = dumps.read_xml_dump(spark, f"{tmp_path}/{folder}", "tags").select(*rows.columns)
        assert sorted(read.collect()) == sorted(rows.collect())


def test_shuffles_go_even_after_an_error(spark):
    before = spark.conf.get(session.CLEANUP, "false")
    try:
        with session.spent_shuffles_go(spark):
            assert spark.conf.get(session.CLEANUP) == "true"
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get(session.CLEANUP) == before
