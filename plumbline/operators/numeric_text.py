"""DL006: text columns that are numbers but for a few values."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from ..plans.findings import lint_rows
from ..plans.table import Table
from .base import run, table_for

NAME = "numeric_text"
CODE = "DL006"
OK_MESSAGE = "no text column is made of numbers"
OPTIONS = {"low": 0.8, "high": 1.0}
VALID = {name: lambda v: 0 <= float(v) <= 1 for name in OPTIONS}


def shares(table: Table) -> DataFrame:
    return table.profile.where("valid > 0").selectExpr(
        "idx", "valid", "numeric", "numeric / valid as share"
    )


def metrics(df: DataFrame, **options) -> DataFrame:
    """``(column, valid, numeric, share)`` for text columns with any content."""
    table = table_for(sys.modules[__name__], df, options)
    return shares(table).select(table.name.alias("column"), "valid", "numeric", "share")


def flagged(table: Table) -> DataFrame:
    low = float(table.options[NAME]["low"])
    high = float(table.options[NAME]["high"])
    return shares(table).where(f"share > {low}D and share < {high}D")


def lints(table: Table) -> DataFrame:
    return lint_rows(
        flagged(table),
        occurrences="valid - numeric",
        message="'numbers kept as text, next to other texts'",
    )


def samples(table: Table) -> DataFrame | None:
    return table.text_samples(NAME, flagged(table))


def findings(df: DataFrame, **options) -> DataFrame:
    return run(sys.modules[__name__], df, options)
