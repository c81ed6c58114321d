"""Example values for findings: the k smallest, by a total order.

Ranking within each column is cut to k rows per column before anything is
shuffled (WindowGroupLimit), so a column with many offending values costs no
more to move than one with few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest(candidates: DataFrame, order: list[str], value: str, k: int) -> DataFrame:
    """``(check, idx, sample)`` with the first ``k`` of ``value`` in each group."""
    by = ["check", "idx"]
    ranked = (
        candidates.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        )
        .where(F.col("rank") <= k)
        .select(*by, F.struct("rank", F.col(value).alias("value")).alias("entry"))
    )
    entries = F.array_sort(F.collect_list("entry"))
    return ranked.groupBy(*by).agg(
        F.transform(entries, lambda e: e["value"]).alias("sample")
    )
