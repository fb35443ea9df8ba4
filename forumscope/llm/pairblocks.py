"""All members of a key against each other, in pairs of bounded blocks: no pair is ever a row, and no task holds more than two blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 128
TOGETHER_ROWS = 40_000  # rows whose groups are compared at a time, if they
TOGETHER_BYTES = 16 << 20  # are no larger than this
PAIRS_AT_ONCE = 1 << 18  # pairs of numbers that are held at a time


def dealt(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members`` (key, node, n: the key's number of nodes, and others) once for each pair of blocks that they are in: low, high, second.

    A key's nodes are dealt over n / block blocks by a hash; ``second`` tells the two blocks of a pair apart.
    """
    count = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), count.cast("bigint")).cast("int")
    spread = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), count - 1)))
    placed = spread.withColumns({"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other"), "second": F.col("_own") > F.col("_other")})
    return placed.drop("_own", "_other", "n")


def compared(placed: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable[[list[tuple], bool], list[tuple]]]) -> DataFrame:
    """What a function finds in each pair of blocks. ``placed``: as ``dealt`` gives it, with ``columns``.

    ``make`` runs in each task and returns the function: from rows of key, second and ``columns``, and whether the two blocks are one, to
    rows of ``schema``. Groups come sorted, so a task holds one at a time beside the batch that it comes from.
    """

    def one_by_one():
        find = make()
        return lambda groups: [row for rows, one in groups for row in find(rows, one)]

    return compared_together(placed, columns, schema, one_by_one)


def compared_together(
    placed: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable[[list[tuple[list[tuple], bool]]], list[tuple]]]
) -> DataFrame:
    """``compared`` with a function of a list of pairs of blocks: all that end in some record batches, of a bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    together = placed.select("key", "low", "high", "second", *columns)
    together = together.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        at, group = None, []
        ended: list[tuple[list[tuple], bool]] = []
        rows = size = 0
        for batch in batches:
            if rows >= TOGETHER_ROWS or size + batch.nbytes > TOGETHER_BYTES:
                yield as_batch(find(ended))
                ended, rows, size = [], 0, 0
            rows, size = rows + batch.num_rows, size + batch.nbytes
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    if len(group) > 1:
                        ended.append((group, at[1] == at[2]))
                    at, group = row[:3], []
                group.append((row[0], *row[3:]))
        if len(group) > 1:
            ended.append((group, at[1] == at[2]))
        yield as_batch(find(ended))

    return together.mapInArrow(run, schema)


def compared_columns(
    placed: DataFrame, columns: Sequence[str], schema: str, find: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]
) -> DataFrame:
    """``compared_together`` in numpy: ``find`` takes the columns of whole groups (key, low, high, second, ``columns``; none has nulls) and the groups' sizes."""
    names = ("key", "low", "high", "second", *columns)
    together = placed.select(*names).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def ended(last: bool) -> pa.RecordBatch | None:
            rows = {name: np.concatenate(parts) for name, parts in zip(names, zip(*held, strict=True), strict=True)}
            new = np.ones(len(rows["key"]), bool)
            new[1:] = np.any([rows[name][1:] != rows[name][:-1] for name in names[:3]], axis=0)
            starts = np.flatnonzero(new)
            end = len(new) if last else int(starts[-1])
            held[:] = [] if last else [[values[end:] for values in rows.values()]]
            sizes = np.diff(starts, append=len(new)) if last else np.diff(starts)
            return pa.RecordBatch.from_pydict(find({name: values[:end] for name, values in rows.items()}, sizes)) if end else None

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                if sum(len(parts[0]) for parts in held) >= TOGETHER_ROWS and (made := ended(False)) is not None:
                    yield made
        if held:
            yield ended(True)

    return together.mapInArrow(run, schema)


def pairs_within(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y of all pairs of rows that are in one group, ``PAIRS_AT_ONCE`` or the pairs of one row at a time."""
    places = np.arange(sizes.sum())
    after = np.repeat(np.cumsum(sizes), sizes) - places - 1
    upto = np.cumsum(after)
    at = 0
    while at < len(after):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - after[at] + PAIRS_AT_ONCE, side="right")))
        times = after[at:end]
        x = np.repeat(places[at:end], times)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
        at = end


class Forest:
    """Which roots are joined."""

    def __init__(self, roots):
        self.of = {root: root for root in roots}

    def root(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.of[max(x, y)] = min(x, y)
