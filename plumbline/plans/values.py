"""Counting the values of text columns without shuffling the texts.

Grouping by value would send every distinct text across the network. Instead a
first pass finds the few hashes or slots of hashes in which an answer can lie; a
second pass groups the real values of the rows in those. The first pass decides only
what may be left out, the second counts actual values.

Frequent values are found by a summary of frequent items, which the aggregate of the
counters holds for each column, so that nothing is shuffled for them but summaries.
Spellings, and values above a very low threshold, are found by grouping hashes.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound on the rows of the broadcast slot list (8 bytes each).
SLOTS = 1 << 20
# Slots for each value that may pass the threshold, so that few others share one.
SLOTS_PER_VALUE = 8

# A summary of m items errs by 3.5 / m of the rows at most and tells those that are
# sure to have more rows than that; of sixteen items for each value that may pass
# the threshold, it so tells all that do.
ITEMS_PER_VALUE, LEAST_ITEMS = 16, 64
# Below this threshold the summaries would be larger than grouped hashes.
LEAST_THRESHOLD = 0.001


class Heavy(NamedTuple):
    """The summary of a column's frequent hashes, in SQL."""

    key: str
    items: int

    @property
    def sketch(self) -> str:
        return f"approx_top_k_accumulate({self.key}, {self.items})"

    @property
    def blank(self) -> str:
        return f"approx_top_k_accumulate(cast(null as bigint), {self.items})"

    def merged(self, name: str) -> str:
        return f"approx_top_k_combine({name}, {self.items})"

    def keys(self, name: str) -> str:
        found = f"approx_top_k_estimate({name}, {self.items})"
        return f"filter(transform({found}, i -> i.item), key -> key is not null)"


def key_of(text: str, variants: bool) -> str:
    """The hash of a text, or of all its spellings; null has one as well."""
    return f"xxhash64(lower({text}))" if variants else f"xxhash64({text})"


def heavy(text: str, threshold: float | None, variants: bool) -> Heavy | None:
    """None where hashes are grouped instead."""
    if threshold is None or threshold < LEAST_THRESHOLD:
        return None
    items = max(LEAST_ITEMS, -int(-ITEMS_PER_VALUE // threshold))
    return Heavy(key_of(text, variants), items)


def value_groups(
    values: DataFrame,
    columns: int,
    total: Column,
    threshold: float | None,
    variants: bool,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Exact ``(idx, value, n)`` for every value that can matter.

    ``values`` is the long form ``(idx, value)``. With ``threshold``, values
    whose share of all rows exceeds it are included; with ``variants``, all
    spellings of a text that occurs in more than one. Others may or may not be.
    ``keys (idx, key)`` are the hashes of all values above the threshold, if known.
    """
    slots = slots_for(threshold)
    if variants:
        slots = max(slots, power_of_two(SLOTS // columns))
    elif keys is not None:
        slots = SLOTS
    keyed = values.withColumn("key", F.expr(key_of("value", variants)))
    slot = slot_of("key", slots).alias("slot")

    n = F.count(F.lit(1)).alias("n")
    relevant = []
    if variants:
        # Two spellings of one text share the key and differ in their own hash.
        spelling = F.xxhash64("value")
        second = F.xxhash64(F.lit(1), F.col("value"))
        counted = keyed.groupBy("idx", "key").agg(
            n,
            F.min(spelling).alias("low"),
            F.max(spelling).alias("high"),
            F.min(second).alias("low2"),
            F.max(second).alias("high2"),
        )
        varied = (F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2"))
        counted = counted.groupBy("idx", slot).agg(
            F.sum("n").alias("n"), F.max(varied).alias("varied")
        )
        relevant.append(F.col("varied"))
    elif keys is None:
        counted = keyed.groupBy("idx", slot).agg(n)
    if threshold is not None and keys is None:
        relevant.append(F.col("n") / total > F.lit(threshold))
    wanted = []
    if relevant:
        wanted.append(counted.where(reduce(Column.__or__, relevant)).select("idx", "slot"))
    if keys is not None:
        wanted.append(keys.select("idx", slot))
    wanted = reduce(DataFrame.unionByName, wanted)

    return (
        keyed.select("idx", "value", slot)
        .join(F.broadcast(wanted), ["idx", "slot"], "left_semi")
        .groupBy("idx", "value")
        .agg(n)
    )


def slots_for(threshold: float | None) -> int:
    """At most one in ``SLOTS_PER_VALUE`` of the slots can hold a wanted value."""
    if threshold is None:
        return SLOTS_PER_VALUE
    return min(2 * power_of_two(round(SLOTS_PER_VALUE / threshold)), SLOTS)


def power_of_two(n: int) -> int:
    return 1 << max(n, 1).bit_length() - 1


def slot_of(hashed: str, slots: int) -> Column:
    """One of ``slots``, a power of two. Unlike a remainder it is never null,
    which spares the optimizer reasoning about when it could be."""
    return F.col(hashed).bitwiseAND(F.lit(slots - 1))


def spellings(groups: DataFrame) -> DataFrame:
    """Texts found in several spellings: ``(idx, key, n, rows, first, last)``.

    The filter asks for every aggregate, so that whichever of them a reader
    wants, Spark sees the same exchange and runs it once.
    """
    return (
        groups.groupBy("idx", F.lower("value").alias("key"))
        .agg(
            F.count("value").alias("n"),
            F.sum("n").alias("rows"),
            F.min("value").alias("first"),
            F.max("value").alias("last"),
        )
        .where("first <> last and n > 1 and rows >= n")
    )
