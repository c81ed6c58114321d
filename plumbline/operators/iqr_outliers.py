"""DL007: numbers far outside the middle half of their column."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from ..functions import fences
from ..plans.findings import lint_rows
from ..plans.table import Table
from .base import run, table_for

NAME = "iqr_outliers"
CODE = "DL007"
OK_MESSAGE = "all numbers lie within the fences"
MESSAGE = "numbers below %.2f or above %.2f"
OPTIONS = {"method": "exact", "multiplier": 1.5}
VALID = {
    "method": lambda v: v in ("exact", "approx"),
    "multiplier": lambda v: 0 <= float(v) < float("inf"),
}


def counts(table: Table) -> DataFrame | None:
    """``(idx, q1, q3, lower, upper, outliers)`` for columns with usable fences."""
    if not table.number_fields:
        return None
    lower, upper = fences(table.options[NAME]["multiplier"])
    return table.outliers.selectExpr("*", f"{lower} as lower", f"{upper} as upper")


def metrics(df: DataFrame, **options) -> DataFrame:
    """``(column, q1, q3, lower, upper, outliers)``; a column without spread is left out."""
    table = table_for(sys.modules[__name__], df, options)
    found = counts(table)
    if found is None:
        return df.sparkSession.createDataFrame(
            [],
            "column string, q1 double, q3 double, lower double, upper double, "
            "outliers bigint",
        )
    return found.select(
        table.name.alias("column"), "q1", "q3", "lower", "upper", "outliers"
    )


def lints(table: Table) -> DataFrame | None:
    found = counts(table)
    if found is None:
        return None
    return lint_rows(
        found.where("outliers > 0"),
        occurrences="outliers",
        message=f"format_string('{MESSAGE}', lower, upper)",
    )


def samples(table: Table) -> DataFrame | None:
    return table.number_samples


def findings(df: DataFrame, **options) -> DataFrame:
    return run(sys.modules[__name__], df, options)
