"""Tag strings such as ``<a><b>`` as arrays and as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tag_list(raw: Column) -> Column:
    """Tags in their written order; null stays null."""
    return F.split(F.translate(F.replace(raw, F.lit("><"), F.lit("\n")), "<>", ""), "\n", -1)


def tag_words(raw: Column) -> Column:
    """Tags joined by spaces, each followed by one."""
    return F.concat(F.array_join(tag_list(raw), " "), F.lit(" "))


def distinct_tags(raw: Column) -> Column:
    """Number of different tags; null for a post without tags."""
    return F.size(F.array_distinct(tag_list(raw)))
