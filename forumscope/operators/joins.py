"""Joins whose cost is bounded whatever the key distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

BROADCAST_BYTES = 64 << 20


ROW_BYTES = 48  # what a row of a broadcast hash table takes beside its values


def _width(value: Column, kind: DataType) -> Column | int:
    """Bytes that a value takes in memory: an expression, or a number where all values take the same."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), 16)
    if isinstance(kind, (ArrayType, MapType)):
        items, inner = (value, kind.elementType) if isinstance(kind, ArrayType) else (F.map_entries(value), _entry(kind))
        each = _width(F.lit(None).cast(inner), inner)
        if isinstance(each, int):
            return F.coalesce(F.size(items), F.lit(0)) * each + 32
        total = F.aggregate(items, F.lit(32).cast("bigint"), lambda n, x: n + _width(x, inner))
        return F.coalesce(total, F.lit(32).cast("bigint"))
    return 8


def _entry(kind: MapType) -> StructType:
    return StructType().add("key", kind.keyType).add("value", kind.valueType)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the whole table is small enough to send to every executor, by measuring what it takes in memory."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), ROW_BYTES)
    measured = df.agg(F.sum((F.lit(0) + width).cast("bigint")).alias("bytes")).first()["bytes"]
    return (measured or 0) <= limit


HOT_SHARE = 0.002


def hot_keys(facts: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Every key that holds more than ``share`` of the rows, and perhaps a few others; at most ``1 / share`` in all.

    One pass with a bounded table of counters in each task; no key is shuffled.
    """
    found = facts.select(F.col(key).alias("key")).where("key is not null").stat.freqItems(["key"], share).first()
    return list(found[0] or []) if found else []


def repeat_hot(lookup: DataFrame, key: str, hot: list, salts: int) -> DataFrame:
    """Rows of hot keys once for each salt, the others once, with salt 0."""
    every, one = F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0))
    return lookup.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), every).otherwise(one)))


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: Column,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = 64,
    how: str = "inner",
) -> DataFrame:
    """Inner (or left) join of many rows with a lookup table that is unique on ``key``.

    A lookup that fits is broadcast. For a larger one, one more pass over ``facts`` finds its hot keys; only their rows are spread
    over ``salts`` tasks (``spread`` picks the salt), and only their lookup rows, a few hundred, are repeated. Null keys, which match
    nothing, are spread as well.
    """
    if fits_broadcast(lookup, broadcast_bytes):
        return facts.join(F.broadcast(lookup), key, how)
    hot = hot_keys(facts, key)
    split = F.col(key).isNull() | F.col(key).isin(hot)
    salt = F.when(split, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    return facts.withColumn("_salt", salt).join(repeat_hot(lookup, key, hot, salts), [key, "_salt"], how).drop("_salt")
