"""Exact quartiles and outliers from a sketch and one more pass.

Quartiles are elements of the data: number ``ceil(q * n)`` in ascending order, nulls
and NaN left out. Sorting 100 TB to pick two elements per column is wasteful, and a
percentile aggregate keeps every distinct value of a column in one task. A quantile
sketch of each column, held by the same wide aggregate as the counters, brackets both
quartiles; so it brackets the fences too, as they follow from the quartiles by steps
that keep the order. One more pass counts the values below the brackets and beyond
the fences' and keeps the few inside. Those are binned before any are ranked, so what
a task ranks are bins or the distinct values of a single bin.

The sketch keeps its error with a probability only, so brackets are four times as
wide as its bound, and the counts prove afterwards that they hold the ranks; if they
ever did not, the query fails rather than give a wrong quartile.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Field, fences
from .quantiles import both_quartiles, holding_rank, linear_bin, ranked
from .sharing import shared

if TYPE_CHECKING:
    from .table import Table

# The sketch's size. Its ranks are wrong by 0.13 per cent of all values at most, in
# 99 of 100 cases; the bracket reaches four times as far to both sides.
SKETCH = 4096
REACH = 0.005

QUARTILES = {1: 0.25, 3: 0.75}
ENDS = ("low1", "high1", "low3", "high3")
ENDS_TYPE = "struct<known: bigint, low1: double, high1: double, low3: double, high3: double>"
# What is known of a value: bits of its place among the brackets.
PLACES = {
    1: "x < low1",
    2: "x between low1 and high1",
    4: "x < low3",
    8: "x between low3 and high3",
    16: "x < low0 or x > high4",
    32: "x between low0 and high0",
    64: "x between low4 and high4",
}
INSIDE = 2 | 8 | 32 | 64


def sketch(number: str) -> str:
    known = f"cast(case when not isnan({number}) then {number} end as double)"
    return f"kll_sketch_agg_double({known}, {SKETCH})"


def ends(sketched: str | None) -> str:
    """How many values are known, and the ends of both brackets."""
    if sketched is None:
        return f"cast(null as {ENDS_TYPE})"
    known = f"coalesce(kll_sketch_get_n_double({sketched}), 0)"
    at = ", ".join(
        f"{q - REACH if end == 0 else q + REACH}D" for q in QUARTILES.values() for end in (0, 1)
    )
    found = f"if({known} > 0, kll_sketch_get_quantile_double({sketched}, array({at})), null)"
    values = ", ".join(f"{found}[{k}] as {name}" for k, name in enumerate(ENDS))
    return f"struct({known} as known, {values})"


def fence_ends(multiplier: float) -> dict[str, str]:
    """Between which values each fence lies, over the ends of the brackets.

    A lower fence grows with the first quartile and falls with the third, an upper
    one the other way round; rounding keeps that.
    """

    def fence(which: int, q1: str, q3: str) -> str:
        return fences(multiplier)[which].replace("q1", q1).replace("q3", q3)

    return {
        "low0": fence(0, "low1", "high3"),
        "high0": fence(0, "high1", "low3"),
        "low4": fence(1, "high1", "low3"),
        "high4": fence(1, "low1", "high3"),
    }


class Brackets:
    """Quartiles and outliers of the numeric columns of a table."""

    def __init__(self, table: Table, fields: list[Field], multiplier: float):
        self.multiplier = multiplier
        known = table.profile.where("ends.known > 0").selectExpr("idx", "ends.*")
        self.ends = F.broadcast(
            shared(
                known.selectExpr(
                    "idx as at_idx",
                    "* except (idx)",
                    *[f"{expr} as {name}" for name, expr in fence_ends(multiplier).items()],
                )
            )
        )
        self.numbers = table.numbers(fields).where("x is not null")

    def placed(self) -> DataFrame:
        """``(idx, place, x, n, of)``: counted values, by value inside the brackets.

        ``place`` has the bits of ``PLACES``; outside the brackets ``x`` is zero and
        stands for all values of that place. ``of`` is the place again, but a filter
        on it stays above the aggregate, so that all readers have the same one and
        Spark runs it once.
        """
        place = " | ".join(f"if({place}, {bit}, 0)" for bit, place in PLACES.items())
        return (
            self.numbers.join(self.ends, F.col("idx") == F.col("at_idx"))
            .selectExpr("idx", "x", f"{place} as place")
            .selectExpr("idx", "place", f"coalesce(if(place & {INSIDE} > 0, x, 0D), 0D) as x")
            .groupBy("idx", "place", "x")
            .agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("of"))
        )

    def quartiles(self, values: DataFrame) -> DataFrame:
        """``(idx, q1, q3)`` of columns with any value."""
        # Below the bracket 1, inside 2.
        each = ", ".join(
            f"struct({q}D as q, ceil({q}D * known) as rank, shiftright(of, {kind - 1}) & 3 as at, "
            f"low{kind} as low, high{kind} as high)"
            for kind, q in QUARTILES.items()
        )
        binned = (
            values.join(self.ends, F.col("idx") == F.col("at_idx"))
            .selectExpr("idx", "x", "n", f"inline(array({each}))")
            .where("at > 0")
            .withColumn("bin", F.when(F.col("at") == 1, -1).otherwise(linear_bin()))
            .groupBy("idx", "q", "rank", "bin")
            .agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        )
        last = (
            values.where(f"of & {INSIDE} > 0")
            .select("idx", "x", "n")
            .join(
                F.broadcast(
                    holding_rank(binned, "bin").where("bin >= 0").withColumnsRenamed({"idx": "at_idx"})
                ),
                (F.col("idx") == F.col("at_idx"))
                & (F.col("x") >= F.col("low"))
                & (F.col("x") <= F.col("high")),
            )
        )
        found = both_quartiles(ranked(last, "x").select("idx", "q", "x"))
        proven = "assert_true(q1 is not null and q3 is not null, 'a quartile escaped its bracket')"
        return (
            self.ends.selectExpr("at_idx as idx")
            .join(F.broadcast(found), "idx", "left")
            .where(f"{proven} is null")
        )

    def outliers(self) -> DataFrame:
        """``(idx, q1, q3, outliers)`` of columns with a finite, positive spread."""
        values = self.placed()
        found = shared(self.quartiles(values)).where(
            "q3 - q1 > 0 and q3 - q1 < double('Infinity')"
        )
        lower, upper = fences(self.multiplier)
        beyond = f"of & 16 > 0 or of & 32 > 0 and x < {lower} or of & 64 > 0 and x > {upper}"
        return shared(
            values.join(F.broadcast(found), "idx")
            .groupBy("idx", "q1", "q3")
            .agg(F.expr(f"sum(if({beyond}, n, 0L)) as outliers"))
        )
