"""Reading a small result in several places while computing it once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import one_row


def shared(frame: DataFrame) -> DataFrame:
    """``frame``, computed once per query however many branches read it.

    The rows travel as the value of a scalar subquery. Spark runs equal
    subqueries once, and no filter or column choice of one reader reaches into
    it to make it unequal to another's. Only for frames whose size the schema
    of the linted table bounds: a few rows per column.
    """
    cell = frame.agg(F.collect_list(F.struct("*")).alias("rows")).scalar()
    return unpack(frame.sparkSession, cell)


def unpack(spark: SparkSession, cell: Column) -> DataFrame:
    return one_row(spark).select(F.inline(cell))
