"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources weigh 1, 2, 3, repeating, in code-point order with null last, and share the words of all documents by
weight. A source's target stops at ``max_repeats`` times its size; what it cannot take is reshared by weight.

A document's place in its source is a hash of its id, so a source is a sequence of permuted blocks (the leading
20 bits of the hash, in two levels of 1,024). A source takes whole passes over its blocks and then a prefix of
one more pass. The end of that prefix is found by going down the levels: sums of at most 1,024 children are
scanned per source and level, and only the documents of one block in a million are ordered.

For dealing, a source is cut along its places into blocks of about equal words, the same for all sources, so that a hot
source has more of them. The blocks of all passes are dealt to output shards by a tree: a node's quotas of all sources are
split between its two halves by a multivariate-hypergeometric draw, which is what shuffling all blocks and cutting would
give. The quotas are exact, the shards' blocks disjoint, and shards differ by one block at most. A Spark job takes the tree
down ``FAN_BITS`` levels for all nodes side by side; a task holds one node: a row a source and its shares in at most 64 parts. A
document meets the shard of its block, in each pass, by an equi-join on source and block, and only what was dealt is taken.
Shards follow from the words (``SHARD_WORDS``), never fewer than ``LEAST_SHARDS``.

Defined results: a null text, an empty one or one of separators only has size 0 and is taken 0 times; a null
source is a source of its own and the last in order; a null doc_id has a place like any other; rows that share a
doc_id are placed next to each other and counted each; an empty table gives an empty result; other columns, whatever
their names, are carried by ``mix`` and ignored by ``plan_mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from forumscope.llm.common import packed, stable_hash, stored, table, word_count
from forumscope.operators.joins import fits_broadcast, join_lookup

LEVEL_BITS = 10
BLOCKS = 1 << LEVEL_BITS
MAX_REPEATS = 3
SEED = 17
SHARD_WORDS = 1 << 26
LEAST_SHARDS = 64
BLOCKS_A_SHARD = 256
FAN_BITS = 6
PLACE_BITS = 30  # of a place, that choose its block


def _place(doc_id: Column, seed: int) -> Column:
    return stable_hash(F.lit(seed), doc_id)


def _level(place: str, level: int) -> Column:
    """The child, at a level of the tree, that holds a 60-bit place."""
    shift = 60 - LEVEL_BITS * level
    return F.shiftrightunsigned(F.col(place), shift).bitwiseAND(BLOCKS - 1).cast("int")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: key, size, target, and its quota as whole passes and remaining words.

    Sources are taken in the order of cap over weight. With the first k of them at their caps, the others
    share what is left at one level a unit of weight; the true level is the largest of these over k.
    """
    totals = sizes.groupBy("_key", "_source").agg(F.sum("_size").alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("_source"))
    by_cap = Window.orderBy("_order", "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = (F.col("source_size") * max_repeats).cast("bigint")
    ranked = (
        totals.withColumn("_rank", F.row_number().over(in_order))
        .withColumn("_weight", ((F.col("_rank") - 1) % 3 + 1).cast("bigint"))
        .withColumn("_cap", cap)
        .withColumn("_order", (cap * (6 / F.col("_weight")).cast("bigint")))
    )
    capped = F.coalesce(F.sum("_cap").over(before), F.lit(0))
    passed = F.coalesce(F.sum("_weight").over(before), F.lit(0))
    left = (F.sum("source_size").over(everything) - capped).cast("double")
    level = left / (F.sum("_weight").over(everything) - passed).cast("double")
    target = F.least(F.max("_level").over(everything) * F.col("_weight"), F.col("_cap").cast("double"))
    quota = F.round(F.col("target")).cast("bigint")
    size = F.col("source_size")
    return (
        ranked.withColumn("_level", level)
        .withColumn("target", target)
        .withColumn("_whole", F.when(size > 0, F.floor(quota / size)).otherwise(0).cast("int"))
        .withColumn("_rest", F.when(size > 0, quota - F.col("_whole") * size).otherwise(0).cast("bigint"))
        .select("_key", "_source", "source_size", "target", "_whole", "_rest")
    )


def _descend(sums: DataFrame, ends: DataFrame, level: str) -> DataFrame:
    """For each source, the child in which the remaining words end, and what remains of them there."""
    order = Window.partitionBy("_key").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(order), F.lit(0)))
    inside = (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words"))
    return (
        sums.join(ends, "_key")
        .where(inside)
        .withColumn("_rest", F.col("_rest") - F.col("_before"))
        .drop("_before", "_words")
    )


def plan_mix(
    docs: DataFrame, seed: int = SEED, cut: bool = True, max_repeats: int = MAX_REPEATS, shards: int | None = None
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and what is taken: pass, shard and words of each time.

    ``cut``: the document in which a quota ends is taken in part, so quotas are met to the word. Otherwise it
    is taken whole if that comes nearer.
    """
    sized = _sized(docs, seed).select("_row.doc_id", "_source", "_key", "_size", "_place")
    sizes = stored(sized, "mix-sizes")
    ends = _ends(sizes, max_repeats)
    dealt = deal_blocks(ends, shards or shard_count(ends), seed)
    return _with_takes(_with_passes(sizes, sizes, ends, cut), dealt).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", _taken().alias("taken"), "_takes"
    )


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Working columns beside the whole given row, which is packed so that no name can clash."""
    return docs.select(
        packed(docs),
        F.col("source").alias("_source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_key"),
        word_count(F.col("text")).alias("_size"),
        _place(F.col("doc_id"), seed).alias("_place"),
    )


def _ends(sizes: DataFrame, max_repeats: int) -> DataFrame:
    """One row a source: its target and the two levels of the block in which its last pass ends."""
    targets = stored(source_targets(sizes, max_repeats), "mix-targets")
    blocks = stored(
        sizes.groupBy("_key", _level("_place", 1).alias("_l1"), _level("_place", 2).alias("_l2")).agg(
            F.sum("_size").alias("_words")
        ),
        "mix-blocks",
    )
    rest = targets.where("_rest > 0").select("_key", "_rest")
    upper = _descend(blocks.groupBy("_key", "_l1").agg(F.sum("_words").alias("_words")), rest, "_l1")
    inner = blocks.join(upper.select("_key", "_l1"), ["_key", "_l1"]).select("_key", "_l2", "_words")
    lower = _descend(inner, upper, "_l2").withColumnsRenamed({"_l1": "_end1", "_l2": "_end2", "_rest": "_left"})
    end = (F.col("_end1") * BLOCKS + F.col("_end2")).cast("bigint").alias("_end")
    return stored(targets.join(lower.select("_key", end, "_left"), "_key", "left"), "mix-ends")


def _with_passes(docs: DataFrame, sizes: DataFrame, ends: DataFrame, cut: bool) -> DataFrame:
    """``docs`` with the words taken in each pass. ``sizes``: the working columns of all documents."""
    block = F.shiftrightunsigned(F.col("_place"), 60 - 2 * LEVEL_BITS)
    ends = ends.select("_key", "source_size", "target", "_whole", "_left", "_end")
    placed = join_lookup(docs, ends, "_key", F.col("_place"))
    last = join_lookup(
        sizes.select("_key", "_place", "_size"), ends.where("_end is not null"), "_key", F.col("_place")
    ).where(block == F.col("_end"))
    order = Window.partitionBy("_key").orderBy("_place", "_size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_words").over(order), F.lit(0))
    room = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - F.col("_before")))
    part = room if cut else F.when(room * 2 >= F.col("_size"), F.col("_size")).otherwise(0)
    partial = (  # rows alike in place and size are taken alike: their words are counted together, then dealt
        last.groupBy("_key", "_place", "_size", "_left")
        .agg(F.sum("_size").alias("_words"), F.count("*").alias("_copies"))
        .withColumn("_before", before)
        .withColumn("_size", F.col("_words"))
        .withColumn("_share", part)
        .select("_key", "_place", (F.col("_words") / F.col("_copies")).cast("bigint").alias("_size"),
                F.floor(F.col("_share") / F.col("_copies")).cast("bigint").alias("_part"))
    )
    keys = ["_key", "_place", "_size"]
    if fits_broadcast(partial):
        partial = F.broadcast(partial)
    extra = (
        F.when(F.col("_end").isNull() | (block > F.col("_end")), 0)
        .when(block < F.col("_end"), F.col("_size"))
        .otherwise(F.coalesce(F.col("_part"), F.lit(0)))
    )
    whole = F.array_repeat(F.col("_size"), F.col("_whole"))
    return placed.join(partial, keys, "left").withColumn(
        "_passes", F.filter(F.concat(whole, F.array(extra.cast("bigint"))), lambda n: n > 0)
    )


def shard_count(ends: DataFrame) -> int:
    words = ends.agg(F.sum("target")).first()[0] or 0
    return max(LEAST_SHARDS, -(-int(words) // SHARD_WORDS))


def _split(counts: np.ndarray, first: int, last: int, levels: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The nodes a number of levels below one: their first and last shard, and their blocks of each source."""
    if last - first == 1 or not levels:
        yield first, last, counts
        return
    middle = (first + last) // 2
    total = int(counts.sum())
    left = total * (middle - first) // (last - first)
    rng = np.random.default_rng([seed, first, last])
    drawn = rng.multivariate_hypergeometric(counts, left, method="marginals") if total else counts
    yield from _split(drawn, first, middle, levels - 1, seed)
    yield from _split(counts - drawn, middle, last, levels - 1, seed)


def split_quotas(quotas: dict[str, int], shards: int, seed: int = SEED) -> dict[str, list[int]]:
    """Deal each source's blocks to shards by a tree of multivariate-hypergeometric draws, for quotas in memory.

    Shards differ by one block at most in total.
    """
    names = sorted(quotas)
    counts = np.array([quotas[n] for n in names], dtype=np.int64)
    leaves = [node for _, _, node in _split(counts, 0, shards, shards, seed)]
    return {name: [int(leaf[i]) for leaf in leaves] for i, name in enumerate(names)}


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """The same tree as Spark jobs: (_key, _quota) to (_key, _shard, _quota), without the shards that get nothing of a source."""

    def down(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("_key")
        first, last = int(node["_first"].iloc[0]), int(node["_last"].iloc[0])
        parts = [
            pd.DataFrame({"_key": node["_key"], "_quota": counts, "_first": start, "_last": stop})[counts > 0]
            for start, stop, counts in _split(node["_quota"].to_numpy(), first, last, FAN_BITS, seed)
        ]
        return pd.concat(parts)

    nodes = quotas.where("_quota > 0").select(
        "_key", F.col("_quota").cast("bigint").alias("_quota"),
        F.lit(0).cast("bigint").alias("_first"), F.lit(shards).cast("bigint").alias("_last"),
    )
    for _ in range(-(-(shards - 1).bit_length() // FAN_BITS)):
        nodes = stored(nodes.groupBy("_first", "_last").applyInPandas(down, nodes.schema), "mix-nodes")
    return nodes.select("_key", F.col("_first").cast("int").alias("_shard"), "_quota")


def _block(place: Column, blocks: Column) -> Column:
    """The block of a place, of a number of blocks that cut a source along its places."""
    leading = F.shiftrightunsigned(place, 60 - PLACE_BITS)
    return F.shiftrightunsigned(leading * blocks, PLACE_BITS)


def deal_blocks(ends: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Per source and block: the source's number of blocks, and the shard that takes the block in each pass."""
    words = ends.agg(F.sum("target")).first()[0] or 0
    block_words = max(1, int(words) // (shards * BLOCKS_A_SHARD))
    wanted = F.ceil(F.col("source_size") / block_words)
    last = F.shiftleft(F.col("_end") + 1, 60 - 2 * LEVEL_BITS) - 1  # the last place of the part in which the quota ends
    cut = ends.withColumn("_blocks", F.greatest(F.lit(1), F.least(F.lit(1 << PLACE_BITS), wanted)).cast("bigint"))
    cut = cut.withColumn("_quota", F.col("_whole") * F.col("_blocks") + F.coalesce(_block(last, F.col("_blocks")) + 1, F.lit(0)))
    order = Window.partitionBy("_key").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = split_tree(cut.select("_key", "_quota"), shards, seed).withColumn(
        "_from", F.coalesce(F.sum("_quota").over(order), F.lit(0))
    )
    each = runs.join(cut.select("_key", "_blocks"), "_key").select(
        "_key", "_blocks", "_shard", F.explode(F.sequence("_from", F.col("_from") + F.col("_quota") - 1)).alias("_n")
    )
    taken = F.struct(F.expr("CAST(_n DIV _blocks AS INT)").alias("pass"), F.col("_shard").alias("shard"))
    return stored(
        each.groupBy("_key", "_blocks", (F.col("_n") % F.col("_blocks")).alias("_block")).agg(
            F.array_sort(F.collect_list(taken)).alias("_dealt")  # a pass each, ``max_repeats`` at most
        ),
        "mix-dealt",
    )


def _with_takes(placed: DataFrame, dealt: DataFrame) -> DataFrame:
    """What each document gives in the passes in which its block was dealt to a shard."""
    counts = dealt.groupBy("_key").agg(F.first("_blocks").alias("_blocks"))
    placed = join_lookup(placed, counts, "_key", F.col("_place"), how="left")
    placed = placed.withColumn("_block", _block(F.col("_place"), F.col("_blocks")))
    dealt = dealt.drop("_blocks")
    if fits_broadcast(dealt):
        dealt = F.broadcast(dealt)
    takes = F.transform(
        F.coalesce("_dealt", F.array().cast("array<struct<pass: int, shard: int>>")),
        lambda d: F.struct(d["pass"], d["shard"], F.get("_passes", d["pass"]).alias("words")),
    )
    return placed.join(dealt, ["_key", "_block"], "left").withColumn(
        "_takes", F.filter(takes, lambda t: t["words"].isNotNull())
    )


def _taken() -> Column:
    return F.aggregate("_takes", F.lit(0).cast("bigint"), lambda total, t: total + t["words"])


def mix(
    docs: DataFrame,
    shards: int | None = None,
    seed: int = SEED,
    max_repeats: int = MAX_REPEATS,
    shard_column: str | None = None,
) -> DataFrame:
    """The mixed documents, whole, once for each time they are taken, dealt to shards and shuffled within them.

    A document that is not taken is left out. Partition i holds shard i and nothing else, so that a written table has a file a shard;
    ``shard_column`` adds the shard's number under that name, which must not be a column of ``docs``.
    """
    if shard_column is not None and shard_column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{shard_column} is a column of the documents")
    sized = _sized(docs, seed)
    sizes = stored(sized.select("_source", "_key", "_size", "_place"), "mix-sizes")
    ends = _ends(sizes, max_repeats)
    shards = shards or shard_count(ends)
    dealt = deal_blocks(ends, shards, seed)
    taken = _with_takes(_with_passes(sized, sizes, ends, cut=False), dealt).select(
        "_row", "_place", F.explode("_takes").alias("_take")
    )
    order = F.xxhash64("_place", "_take.pass", F.lit(seed))
    return (
        taken.repartitionById(shards, F.col("_take.shard"))
        .sortWithinPartitions(order)
        .select("_row.*", *([F.col("_take.shard").alias(shard_column)] if shard_column else []))
    )


def op10_mixing(spark, folder: str) -> DataFrame:
    planned = plan_mix(table(spark, folder, "documents"))
    return planned.withColumn("n_takes", F.size("_takes").cast("bigint")).drop("_takes")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS place
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
           ORDER BY 3 * source_size * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (
           ORDER BY 3 * source_size * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM totals),
targets AS (
  SELECT source, source_size, least(max(level) OVER () * w, (3 * source_size)::DOUBLE) AS target FROM levels),
quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM targets)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + part)::BIGINT AS taken,
       (CASE WHEN size > 0 THEN whole ELSE 0 END + (part > 0)::INT)::BIGINT AS n_takes
FROM (
  SELECT doc_id, size, source_size, target, whole, greatest(0, least(size, rest - coalesce(sum(size) OVER (
    PARTITION BY s.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source)
"""
