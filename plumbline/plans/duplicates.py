"""Grouping equal rows without shuffling the rows that have no equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import Field
from .values import slot_of


# Slots of the filter; 64 of them are one row of the broadcast list, which so
# has at most ``SLOTS / 64`` rows of 16 bytes, and no more than there are
# repeated hashes.
SLOTS = 1 << 26


def duplicate_groups(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Every row that occurs more than once, with its count ``n``.

    Rows that cannot have an equal are left out first; the others are grouped by
    their actual values. Hashes that collide, or leave out a column that cannot
    be hashed, cost work and change no count.
    """
    keys = [f.col for f in fields] or [F.lit(0).alias("none")]
    return (
        candidates(rows, fields)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def candidates(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """All rows that have an equal, and few others.

    A first pass counts 8-byte row hashes. Equal rows have equal hashes, so
    only rows whose hash falls in a slot with a repeated one go on.
    """
    columns = [f.col for f in fields]
    hashable = [f.col for f in fields if hashes_like_groups(f.type)]
    if not hashable:
        return rows
    hashed = rows.withColumn("hash", F.xxhash64(*hashable))
    slot = slot_of("hash", SLOTS)
    cell = F.shiftright(slot, 6).alias("cell")
    bit = slot.bitwiseAND(63).cast("int").alias("bit")
    repeated = (
        hashed.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .groupBy(cell)
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits"))
    )
    return (
        hashed.select(*columns, cell, bit)
        .join(F.broadcast(repeated), "cell")
        .where(F.expr("shiftrightunsigned(bits, bit) & 1L = 1L"))
        .select(*columns)
    )


def hashes_like_groups(data_type: T.DataType) -> bool:
    """Whether values that group together are sure to hash alike.

    Not so for maps and variants, which have no hash, and for strings under a
    collation of their own, which compare by it.
    """
    if isinstance(data_type, T.StructType):
        return all(hashes_like_groups(f.dataType) for f in data_type)
    if isinstance(data_type, T.ArrayType):
        return hashes_like_groups(data_type.elementType)
    if isinstance(data_type, T.StringType):
        return data_type == T.StringType()
    if isinstance(data_type, T.VariantType):
        return False
    return isinstance(data_type, (T.AtomicType, T.NullType))
