"""Community tables derived from the given star-schema and document tables.

The given data holds no forum dump, so users, badges, questions, answers and posts with text are views
over it. ``plans/oracle.py`` states the same views in SQL. Ids are BIGINT so that they hold at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumscope.functions.text import tokens
from forumscope.schemas import ANSWER, QUESTION

ANSWER_ID_BASE = 1_000_000_000_000
ISO = "yyyy-MM-dd\\'T\\'HH:mm:ss.SSS"
ASKED_TEXT = (
    "format_string('%04d-%02d-%02dT08:30:00.000', 2012 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28)"
)


class Community:
    """The community views over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its files are listed once for each instance."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    def users(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS _Id", "CAST(floor(c_acctbal) AS INT) AS _Reputation", "c_name AS _DisplayName"
        )

    def badges(self) -> DataFrame:
        """A badge for every order, in three classes by priority."""
        return self.table("orders").selectExpr(
            "o_orderkey AS _Id",
            "o_custkey AS _UserId",
            "substr(o_orderpriority, 3) AS _Name",
            f"date_format(o_orderdate, '{ISO}') AS _Date",
            "1 + CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 AS _Class",
            "o_orderkey % 5 = 0 AS _TagBased",
        )

    def _answer_rows(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_partkey").alias("owner"),
                F.expr("max(floor(l_extendedprice)) AS price"),
                F.expr("max(l_quantity * l_quantity) AS size"),
            )
            .selectExpr(
                f"{ANSWER_ID_BASE} + l_orderkey * 10 + l_linenumber AS _Id",
                "l_orderkey AS _ParentId",
                "owner AS _OwnerUserId",
                "CAST(price % 41 - 10 AS INT) AS _Score",
                "CAST(size * l_linenumber * l_linenumber * 7 AS INT) AS delay",
            )
        )

    def answers(self) -> DataFrame:
        asked = self.table("orders").selectExpr("o_orderkey AS _ParentId", "o_orderdate")
        return self._answer_rows().join(asked, "_ParentId").selectExpr(
            "_Id",
            f"{ANSWER} AS _PostTypeId",
            f"date_format(timestampadd(SECOND, delay, o_orderdate), '{ISO}') AS _CreationDate",
            "_Score",
            "_OwnerUserId",
        )

    def _tag_strings(self) -> DataFrame:
        """All part names of each order, and the type on its first line, in order of name."""
        parts = self.table("part").selectExpr("p_partkey AS l_partkey", "p_name", "p_type")
        kinds = "CASE WHEN l_linenumber = 1 THEN lower(p_type) END"
        tags = self.table("lineitem").join(parts, "l_partkey").selectExpr(
            "l_orderkey", f"explode(array_compact(array(replace(p_name, ' ', '-'), {kinds}))) AS tag"
        )
        return tags.groupBy("l_orderkey").agg(
            F.expr("concat('<', array_join(array_sort(collect_set(tag)), '><'), '>') AS _Tags")
        )

    def questions(self, with_tags: bool = False) -> DataFrame:
        """Questions; the tag column, which costs a join, only where a query reads it."""
        first = self._answer_rows().groupBy(F.col("_ParentId").alias("o_orderkey")).agg(
            F.expr("min(_Id) AS first_id"), F.expr("CAST(count(*) AS INT) AS n")
        )
        base = self.table("orders").join(first, "o_orderkey", "left")
        if with_tags:
            base = base.join(self._tag_strings().withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
        return base.selectExpr(
            "o_orderkey AS _Id",
            f"{QUESTION} AS _PostTypeId",
            "CASE WHEN o_orderstatus = 'F' THEN first_id END AS _AcceptedAnswerId",
            f"date_format(o_orderdate, '{ISO}') AS _CreationDate",
            "CAST(floor(o_totalprice) % 41 - 10 AS INT) AS _Score",
            "CAST(floor(o_totalprice / 100) AS INT) AS _ViewCount",
            "CASE WHEN o_custkey % 10 <> 3 THEN o_custkey END AS _OwnerUserId",
            *(["_Tags"] if with_tags else []),
            "coalesce(n, 0) AS _AnswerCount",
        )

    def posts(self, with_tags: bool = False) -> DataFrame:
        """Questions and answers in one table."""
        return self.questions(with_tags).unionByName(self.answers(), allowMissingColumns=True)

    def texts(self) -> DataFrame:
        """Questions with title, body and tags from the documents; the last quarter of every third is code."""
        cut = "CAST(floor(n_chars * 3 / 4) AS INT)"
        rest = f"substring(text, {cut} + 1)"
        ending = f"CASE WHEN doc_id % 3 = 0 THEN concat('<pre><code>', {rest}, '</code></pre>') ELSE concat('<p>', {rest}, '</p>') END"
        return self.table("documents").join(self.table("labels"), "doc_id", "left").selectExpr(
            "doc_id AS _Id",
            f"{QUESTION} AS _PostTypeId",
            f"CASE WHEN quality = 1 THEN doc_id + {ANSWER_ID_BASE} END AS _AcceptedAnswerId",
            f"{ASKED_TEXT} AS _CreationDate",
            "CAST(n_chars % 41 - 10 AS INT) AS _Score",
            "CAST(n_chars * 3 AS INT) AS _ViewCount",
            f"concat('<p>', substring(text, 1, {cut}), '</p>', {ending}) AS _Body",
            "substring_index(text, '\\n', 1) AS _Title",
            "concat('<', lang, '><', source, '>') AS _Tags",
            "CASE WHEN quality IS NULL THEN 0 ELSE 1 + toxic END AS _AnswerCount",
            "CAST(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END AS INT) AS _CommentCount",
            "CAST(CASE WHEN doc_id % 4 = 0 THEN n_chars % 11 END AS INT) AS _FavoriteCount",
        )

    def text_answers(self) -> DataFrame:
        """Accepted answers of the text questions; every thirteenth is missing."""
        kept = self.table("labels").where("quality = 1 AND doc_id % 13 <> 0")
        delay = "CAST(n_chars * n_chars % 2000000 + doc_id % 60 AS INT)"
        asked = f"CAST({ASKED_TEXT} AS TIMESTAMP_NTZ)"
        return self.table("documents").join(kept, "doc_id").selectExpr(
            f"doc_id + {ANSWER_ID_BASE} AS _Id",
            f"{ANSWER} AS _PostTypeId",
            f"date_format(timestampadd(SECOND, {delay}, {asked}), '{ISO}') AS _CreationDate",
        )

    def markup(self) -> DataFrame:
        """Text questions and raw web pages as (_Id, _Body); page ids are negative."""
        pages = self.table("pages").selectExpr("-1 - page_id AS _Id", "html AS _Body")
        return self.texts().select("_Id", "_Body").unionByName(pages)

    def lexicon(self) -> DataFrame:
        """Word valences around zero from the quality labels of the documents that use a word."""
        used = (
            self.table("documents")
            .join(self.table("labels"), "doc_id")
            .select("quality", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        )
        return (
            used.groupBy("term")
            .agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))
            .selectExpr("term", "good * 2.0D / n - 1.7D AS valence")
        )

    def dump(self, table: str) -> DataFrame:
        """One of the five dump tables, as the ingest queries write and read it."""
        return getattr(self, f"_dump_{table}")()

    def _dump_tags(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS _Id",
            "replace(p_name, ' ', '-') AS _TagName",
            "p_size AS _Count",
            "CASE WHEN p_size % 2 = 0 THEN p_partkey * 2 END AS _ExcerptPostId",
            "CASE WHEN p_size % 3 = 0 THEN p_partkey * 3 END AS _WikiPostId",
        )

    def _dump_postlinks(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS _Id",
            f"date_format(o_orderdate, '{ISO}') AS _CreationDate",
            "o_orderkey AS _PostId",
            "o_custkey AS _RelatedPostId",
            "CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END AS _LinkTypeId",
        )

    def _dump_badges(self) -> DataFrame:
        return self.badges()

    def _dump_users(self) -> DataFrame:
        return self.users().selectExpr(
            "*",
            "_Reputation % 97 AS _Views",
            "_Reputation % 31 AS _UpVotes",
            "_Reputation % 13 AS _DownVotes",
            "format_string('%04d-01-02T03:04:05.678', 2008 + _Id % 10) AS _CreationDate",
            "CASE WHEN _Id % 3 <> 0 THEN '2021-02-03T04:05:06.789' END AS _LastAccessDate",
            "concat('<b>', _DisplayName, '</b> & \"more\"') AS _AboutMe",
        )

    def _dump_posts(self) -> DataFrame:
        """Questions, answers and the text questions with title and body."""
        return self.posts(with_tags=True).unionByName(self.texts(), allowMissingColumns=True)
