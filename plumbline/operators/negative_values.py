"""DL008: numeric columns that hold values below zero."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from ..plans.findings import lint_rows
from ..plans.table import Table
from .base import run, table_for

NAME = "negative_values"
CODE = "DL008"
OK_MESSAGE = "no number is below zero"
OPTIONS: dict = {}


def counts(table: Table) -> DataFrame:
    return table.profile.where("negative is not null")


def metrics(df: DataFrame) -> DataFrame:
    """``(column, total, negative)`` for every numeric column."""
    table = table_for(sys.modules[__name__], df, {})
    return counts(table).select(table.name.alias("column"), "total", "negative")


def lints(table: Table) -> DataFrame:
    return lint_rows(
        counts(table).where("negative > 0"),
        occurrences="negative",
        message="'numbers below zero'",
    )


def samples(table: Table) -> DataFrame | None:
    return table.number_samples


def findings(df: DataFrame) -> DataFrame:
    return run(sys.modules[__name__], df, {})
