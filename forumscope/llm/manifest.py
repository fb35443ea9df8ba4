r"""A Merkle manifest of a table: every row's leaf, its group's root, the table's root, and a proof of membership for each row.

A leaf is the SHA-256 of a row's columns, each written with its length. In a group, leaves in order are joined three at a time until one
node is left, the group's root; the groups' roots in order give the table's root in the same way. A row's proof is the path of siblings from
its leaf to the root.

The tree is a rollup of rank digits. A row's place in its group, written to base three, is its path in the tree: grouping the last digit away makes the lowest
nodes, grouping the next one away the nodes above, each with its children nested in an array of structs. Groupings go
on inside a block of 243 places (five digits): rows are dealt to tasks by group and block once, every further grouping is coarser and needs no shuffle, and no
task ever holds more than a block together, however large its group is. One final transform walks a nested block from its top to its leaves and hands each leaf
its siblings, one explode emits them as rows: rows are never joined for their proofs. Only the blocks' own roots, one row for 243, go through the same rollup again,
and give the part of the path above a block to that block, as one row to one row.

Places come from a sort by ranges: every row's place in its task is counted there, and the tasks' counts for each group (a row a group and task)
are summed up. A group that holds most rows is spread over many ranges.

Defined results: null columns are written ``-``, so null and empty differ; rows of a group ascend by the order column, null first, equal ones by
their leaves; repeated rows are a leaf each; a null group is a group, the first one; a lone leaf is its group's root, and a lone group's root the table's; an empty
table has no leaf and gives an empty result. Only the named columns are hashed, other columns are ignored unless carried; their names may clash with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumscope.llm.common import small, stored, table
from forumscope.llm.resampling import sql_crc32

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
DIGITS = 5  # of a block: 243 rows
TASK_BITS = 33  # of monotonically_increasing_id: what is above them is the task


def written(value: Column) -> Column:
    """A value with its length in UTF-8 bytes, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """The leaf of a row; ``changed`` replaces some of its columns."""
    changed = changed or {}
    return F.sha2(F.concat(*[written(changed.get(c, F.col(f"`{c}`"))) for c in columns]), 256)


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with place (from 0) and n, the group's size. ``rows``: group and the columns of ``order``; they are a stored table."""
    keys = [F.col("group").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    laid = stored(laid.withColumn("task", F.shiftright("at", TASK_BITS)), "merkle-order")
    runs = laid.groupBy("group", "task").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    inside = Window.partitionBy("group")
    before = F.sum("size").over(inside.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        F.col("group").alias("_group"),
        F.col("task").alias("_task"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("size").over(inside).alias("n"),
    )
    runs = small(stored(runs, "merkle-runs"), F.coalesce(F.octet_length(F.col("_group").cast("string")), F.lit(0)) + 64)
    same = (F.col("task") == F.col("_task")) & F.col("group").eqNullSafe(F.col("_group"))
    return laid.join(runs, same).withColumn("place", F.col("at") + F.col("_shift")).drop("at", "task", "_group", "_task", "_shift")


def blocks(nodes: DataFrame) -> DataFrame:
    """Nested blocks: group, n, block, tree. ``nodes``: group, n, place, hash, item (what the proof of a node is for).

    A tree is a struct of its hash and its children, down to the nodes. A level that has one node in the whole
    group is the group's root already, and is handed on as it is.
    """
    digit = [F.pmod(F.floor(F.col("place") / ARITY**j), F.lit(ARITY)).cast("int").alias(f"d{j}") for j in range(DIGITS)]
    block = F.floor(F.col("place") / ARITY**DIGITS).alias("block")
    level = nodes.select("group", "n", block, *digit, F.struct("hash", "item").alias("tree")).repartition("group", "block")
    for j in range(DIGITS):
        keys = ["group", "n", "block", *[f"d{i}" for i in range(DIGITS - 1, j, -1)]]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), F.col("tree").alias("t"))))
        level = level.groupBy(*keys).agg(F.transform(kids, lambda k: k["t"]).alias("kids"))
        hashes = F.transform("kids", lambda k: k["hash"])
        hash_ = F.when(F.col("n") > ARITY**j, F.sha2(_joined(hashes), 256)).otherwise(F.get(hashes, F.lit(0)))
        level = level.select(*keys, F.struct(hash_.alias("hash"), F.col("kids")).alias("tree"))
    return level


def unfolded(trees: DataFrame) -> DataFrame:
    """Each node of the blocks with its path: group, item, hash, path, top. ``trees``: blocks with path, that of the block's root, and top.

    A step of a path holds the siblings to the left and to the right, each as joined text; the lowest step is first.
    """

    def step(kids: Column, at: Column) -> Column:
        hashes = F.transform(kids, lambda k: k["hash"])
        left, right = F.slice(hashes, F.lit(1), at), F.slice(hashes, at + 2, F.lit(ARITY))
        return F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right")))

    def walk(tree: Column, height: int, path: Column) -> Column:
        if not height:
            return F.array(F.struct(tree["item"].alias("item"), tree["hash"].alias("hash"), path.alias("path")))
        kids, joined = tree["kids"], F.col("n") > ARITY ** (height - 1)
        return F.flatten(
            F.transform(kids, lambda k, at: walk(k, height - 1, F.when(joined, F.concat(step(kids, at), path)).otherwise(path)))
        )

    return trees.select("group", "top", F.inline(walk(F.col("tree"), DIGITS, F.col("path"))))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Stored blocks of the nodes, of the blocks' roots, and so on to one block for each group. ``nodes``: as for ``blocks``."""
    levels = [stored(blocks(nodes), "merkle-blocks")]
    while levels[-1].agg(F.max("block")).first()[0]:
        roots = levels[-1].select("group", F.ceil(F.col("n") / ARITY**DIGITS).alias("n"), F.col("block").alias("place"), "tree.hash", F.col("block").alias("item"))
        levels.append(stored(blocks(roots), "merkle-blocks"))
    return levels


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes that were climbed from, with whole paths. ``above``: group, top, path of each group's root."""
    above = above.withColumn("item", F.lit(0).cast("bigint"))
    for blocks_ in reversed(levels):
        over = above.select(F.col("group").alias("_group"), F.col("item").alias("_block"), "path", "top")
        width = F.size("path") * 160 + F.coalesce(F.octet_length(F.col("_group").cast("string")), F.lit(0)) + 64
        over = small(stored(over, "merkle-paths"), width)
        above = unfolded(blocks_.join(over, (F.col("block") == F.col("_block")) & F.col("group").eqNullSafe(F.col("_group"))))
    return above


def manifest(rows: DataFrame) -> DataFrame:
    """group, hash, item, subroot, root and path of every leaf. ``rows``: group, order, hash (the leaf), item (what is carried)."""
    rows = stored(rows, "merkle-leaves")
    levels = climb(places(rows, ["order", "hash"]).select("group", "n", "place", "hash", "item"))
    tops = levels[-1].select(F.lit(0).alias("group"), "tree.hash", F.struct(F.col("group").alias("source"), F.col("tree.hash").alias("subroot")).alias("item"))
    tops = stored(tops, "merkle-tops").withColumn("order", F.col("item.source"))
    over = climb(places(tops, ["order"]).select("group", "n", "place", "hash", "item"))
    first = over[-1].select("tree.hash").first()
    root = first["hash"] if first else None
    step = "array<struct<left:string,right:string>>"
    start = over[-1].select("group", F.lit(root).alias("top"), F.array().cast(step).alias("path"))
    named = descend(over, start).select(F.col("item.source").alias("group"), F.col("item.subroot").alias("top"), "path")
    found = descend(levels, named)
    return found.select("group", "hash", "item", F.col("top").alias("subroot"), F.lit(root).alias("root"), "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return _joined(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def document_manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", columns: Sequence[str] = COLUMNS, **carry: Column) -> DataFrame:
    """The manifest of a table by its columns: ``order``, leaf, ``carry``, subroot, root and path, a row for every row."""
    items = F.struct(F.col(f"`{order}`").alias("order"), *[c.alias(n) for n, c in carry.items()])
    rows = docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), leaf(columns).alias("hash"), items.alias("item"))
    kept = [F.col(f"item.{n}").alias(n) for n in carry]
    return manifest(rows).select(F.col("item.order").alias(order), F.col("hash").alias("leaf"), *kept, "subroot", "root", "path")


def op12_manifest(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    tampered = leaf(COLUMNS, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    found = document_manifest(docs, given=F.when(even, tampered))
    back = folded(F.coalesce("given", "leaf"), F.col("path"))
    made = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


def _sql_tree(name: str, nodes: str, group: str) -> str:
    return f"""{name} AS (
  SELECT 0 AS level, {group} AS grp, place AS idx, n, hash FROM {nodes}
  UNION ALL
  SELECT level + 1, grp, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY level, grp, n, idx // {ARITY}
)"""


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS hash,
    CASE WHEN {sql_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS given,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM documents
), {_sql_tree("low", "leaves", "source")}, subroots AS (
  SELECT grp AS source, hash, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), {_sql_tree("high", "subroots", "0")}, steps AS (
  SELECT doc_id, level, string_agg(CASE WHEN idx < place // ({ARITY} ** level)::BIGINT THEN low.hash ELSE '' END, '' ORDER BY idx) AS l,
    string_agg(CASE WHEN idx > place // ({ARITY} ** level)::BIGINT THEN low.hash ELSE '' END, '' ORDER BY idx) AS r
  FROM leaves JOIN low ON low.grp IS NOT DISTINCT FROM source AND low.n > 1 AND idx // {ARITY} = place // ({ARITY} ** (level + 1))::BIGINT
  GROUP BY doc_id, level
  UNION ALL
  SELECT doc_id, 1000 + level, string_agg(CASE WHEN idx < s.place // ({ARITY} ** level)::BIGINT THEN high.hash ELSE '' END, '' ORDER BY idx),
    string_agg(CASE WHEN idx > s.place // ({ARITY} ** level)::BIGINT THEN high.hash ELSE '' END, '' ORDER BY idx)
  FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source
    JOIN high ON high.n > 1 AND idx // {ARITY} = s.place // ({ARITY} ** (level + 1))::BIGINT
  GROUP BY doc_id, level
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM steps
), proofs AS (
  SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM numbered GROUP BY doc_id
), fold AS (
  SELECT doc_id, 0::BIGINT AS step, given AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(l || node || r) FROM fold f JOIN numbered p ON p.doc_id = f.doc_id AND p.step = f.step + 1
)
SELECT d.doc_id, d.hash AS leaf, s.hash AS subroot, (SELECT hash FROM high WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
  f.node AS folded_root, f.node = (SELECT hash FROM high WHERE n = 1) AS verified
FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN proofs USING (doc_id)
  JOIN (SELECT doc_id, arg_max(node, step) AS node FROM fold GROUP BY doc_id) f USING (doc_id)
"""
