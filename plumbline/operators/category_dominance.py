"""DL003: string and boolean columns in which one value crowds out the rest."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.findings import lint_rows
from ..plans.table import Table
from ..schema import quoted
from .base import run, table_for
from .empty_columns import empty_dataset

NAME = "category_dominance"
CODE = "DL003"
OK_MESSAGE = "no value prevails"
MESSAGE = "%.2f %% of the values are '%s'"
OPTIONS = {"threshold": 0.90, "columns": None}
VALID = {"threshold": lambda v: 0 < float(v) <= 1}


def dominant(table: Table) -> DataFrame | None:
    """``(idx, value, n, share)``; null is a value like any other."""
    fields = table.text_fields(NAME)
    if not fields:
        return None
    threshold = float(table.options[NAME]["threshold"])
    return (
        table.value_groups(NAME)
        .withColumn("share", F.col("n") / table.total)
        .where(F.col("share") > F.lit(threshold))
    )


def metrics(df: DataFrame, **options) -> DataFrame:
    """``(column, value, n, share)`` for every value above the threshold."""
    table = table_for(sys.modules[__name__], df, options)
    found = dominant(table)
    if found is None:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, n bigint, share double"
        )
    return found.select(table.name.alias("column"), "value", "n", "share")


def lints(table: Table) -> DataFrame:
    note = empty_dataset(table)
    found = dominant(table)
    if found is None:
        return note
    return lint_rows(
        found,
        occurrences="n",
        sample="array(value)",
        message=f"format_string({quoted(MESSAGE)}, share * 100D, "
        "coalesce(value, 'null'))",
    ).unionByName(note)


def findings(df: DataFrame, **options) -> DataFrame:
    return run(sys.modules[__name__], df, options)
