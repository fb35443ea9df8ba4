"""What the operators share: reading tables, stored intermediate tables, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumscope.session import shared_folder, spent_shuffles_go

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: what follows no longer depends on its tasks.

    Its shuffle files are of no more use then, and go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with spent_shuffles_go(spark):
        df.write.parquet(path)
    if _noted:
        _noted[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The paths of tables that were stored inside each ``settled`` that is at work, the innermost last.
_noted: list[list[str]] = []


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; the tables that were stored on the way are of no more use then, and are deleted."""
    _noted.append([])
    try:
        made = stored(make(), name)
    finally:
        paths = _noted.pop()
    kept = paths.pop()
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if _noted:
        _noted[-1].append(kept)
    return made


def packed(df: DataFrame, name: str = "_row") -> Column:
    """A whole row as one column, so that working columns can have any name; ``name.*`` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


SMALL_BYTES = 16 << 20


def small(df: DataFrame, width: Column | int = 64, limit: int = SMALL_BYTES) -> DataFrame:
    """Marked for broadcast if its measured size allows, else as it is. ``width``: a row's bytes."""
    width = F.lit(width) if isinstance(width, int) else width
    measured = df.agg(F.sum(width.cast("bigint")).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if measured <= limit else df


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def stable_hash(*parts: Column) -> Column:
    """60 bits of MD5, the same in every engine; a null part counts as a mark of its own."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def map_arrow(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]
) -> DataFrame:
    """Apply a function of record batches; ``make`` runs once in each task and returns it.

    The function returns the output columns as lists or arrays, or None for no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch)
            if made is not None:
                columns = [
                    made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], type=f.type)
                    for f in out
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.mapInArrow(run, schema)
