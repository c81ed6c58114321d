"""DL002: columns in which every row is null."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from ..plans.findings import lint_rows
from ..plans.table import Table
from ..schema import OK, one_row, quoted
from .base import run, table_for

NAME = "empty_columns"
CODE = "DL002"
OK_MESSAGE = "every column holds some value"
EMPTY_DATASET = "no rows, so no column was looked at"
OPTIONS: dict = {}


def metrics(df: DataFrame) -> DataFrame:
    """``(column, total, nulls)`` for every column."""
    table = table_for(sys.modules[__name__], df, {})
    return table.profile.select(table.name.alias("column"), "total", "nulls")


def lints(table: Table) -> DataFrame:
    found = lint_rows(
        table.profile.where("nulls = total and nulls > 0"),
        occurrences="nulls",
        sample="array(null)",
        message="'column holds nothing but nulls'",
    )
    return found.unionByName(empty_dataset(table))


def empty_dataset(table: Table) -> DataFrame:
    """An OK row that says so, if the table has no rows."""
    return lint_rows(
        one_row(table.spark).where(table.total == 0),
        status=quoted(OK),
        occurrences="0",
        message=quoted(EMPTY_DATASET),
    )


def findings(df: DataFrame) -> DataFrame:
    return run(sys.modules[__name__], df, {})
