"""Approximate quartiles of many columns, and the steps that exact ones share.

A histogram over the whole column, then a finer one over the bucket that holds the
quartile. Every step is a partially aggregated group-by, and what a task ranks are
bins, bounded in number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import root_scale
from .sharing import shared

QUARTILES = (0.25, 0.75)
BINS = 4096


def finely_binned(known: DataFrame) -> DataFrame:
    """The bucket of each quartile, cut into bins of equal width."""
    coarse = known.groupBy("idx", F.expr(root_scale("x")).alias("bin")).agg(*extent())
    return (
        within(known, first_intervals(coarse))
        .groupBy("idx", "q", "rank", linear_bin())
        .agg(*extent())
    )


def both_quartiles(found: DataFrame) -> DataFrame:
    first, third = (f"max(case when q = {q}D then x end)" for q in QUARTILES)
    return found.groupBy("idx").agg(
        F.expr(f"{first} as q1"), F.expr(f"{third} as q3")
    )


def extent() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    ]


def first_intervals(coarse: DataFrame) -> DataFrame:
    """The coarse bucket of each quartile, and the quartile's rank inside it."""
    column = Window.partitionBy("idx")
    before = F.sum("n").over(column.orderBy("bin")) - F.col("n")
    total = F.sum("n").over(column)
    targets = F.array(
        *[
            F.struct(
                F.lit(q).alias("q"),
                (F.ceil(F.lit(q) * F.col("total")) - F.col("before")).alias("rank"),
            )
            for q in QUARTILES
        ]
    )
    return (
        coarse.withColumns({"before": before, "total": total})
        .select("idx", "n", "low", "high", F.inline(targets))
        .where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
        .select("idx", "q", "rank", "low", "high")
    )


def within(known: DataFrame, target: DataFrame) -> DataFrame:
    """Values inside their column's intervals, of which there are two."""
    return known.join(
        F.broadcast(target.withColumnRenamed("idx", "target_idx")),
        (F.col("idx") == F.col("target_idx"))
        & (F.col("x") >= F.col("low"))
        & (F.col("x") <= F.col("high")),
    )


def linear_bin() -> Column:
    """Equal-width bins; halving first keeps the width from overflowing.

    Subtraction, division and multiplication round monotonically, so the bins
    keep the order of the values.
    """
    half = F.lit(0.5)
    width = F.col("high") * half - F.col("low") * half
    offset = F.col("x") * half - F.col("low") * half
    share = F.when(
        (width > 0) & (width < F.lit(float("inf"))), F.try_divide(offset, width)
    )
    step = F.floor(share * F.lit(float(BINS - 1)))
    return F.coalesce(step, F.lit(0)).alias("bin")


def holding_rank(counted: DataFrame, order: str) -> DataFrame:
    """The bin in which the rank falls, the rank now counted inside it."""
    return ranked(counted, order).select("idx", "q", "rank", "low", "high", order)


def ranked(counted: DataFrame, order: str) -> DataFrame:
    ordered = Window.partitionBy("idx", "q").orderBy(order)
    before = F.sum("n").over(ordered) - F.col("n")
    return counted.withColumn("rank", F.col("rank") - before).where(
        (F.col("rank") >= 1) & (F.col("rank") <= F.col("n"))
    )


def approximate_quartiles(numbers: DataFrame) -> DataFrame:
    """``(idx, q1, q3)`` from two histograms; shared by its readers.

    The smallest value of the bin that holds the quartile, so the answer does not
    depend on how the table is partitioned.
    """
    known = numbers.where("x is not null and not isnan(x)")
    fine = finely_binned(known)
    found = shared(holding_rank(fine, "bin").selectExpr("idx", "q", "low as x"))
    return both_quartiles(found)
