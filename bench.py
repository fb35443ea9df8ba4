"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forumscope.plans.catalog import run  # noqa: E402
from forumscope.session import local_session, new_folder  # noqa: E402

TABLES = ("customer", "orders", "lineitem", "part", "documents", "labels", "pages")

HEADLINE = (
    "ingest_users",
    "parquet_roundtrip",
    "question_base",
    "answer_delay",
    "tags_distribution",
    "top_tags",
    "top_tags_year",
    "tags_num",
    "top_tags_80",
    "tag_trend_1_20",
    "top_tags_response",
    "user_badges",
    "user_answer_score_sum",
    "user_accepted_answers",
    "user_answered_share",
    "corr_user_badges",
    "user_badges_box",
    "text_clean",
    "text_counts",
    "cosine_post_title",
    "sentiment_lexicon",
    "question_metrics",
    "hist_delay_hours",
    "hist_cos_post_title",
    "corr_features",
    "pca_variance",
    "tag_tfidf",
    "tag_kmeans",
    "tag_levenshtein",
    "tag_affinity",
)


def laid_out(spark, folder: str, files: int) -> str:
    """The given tables in several files each, as tables of any size are: one row group is one task."""
    out = new_folder(spark, "bench-tables")
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench", **{"spark.driver.memory": "12g"})
    inputs = laid_out(spark, folder, 2 * int(cores))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(name, spark, inputs).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
