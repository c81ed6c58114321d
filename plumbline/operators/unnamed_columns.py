"""DL001: columns without a name of their own."""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame

from ..plans.findings import lint_rows
from ..plans.table import Table
from ..schema import one_row
from .base import run, table_for

NAME = "unnamed_columns"
CODE = "DL001"
OK_MESSAGE = "every column has a name"
OPTIONS = {"match_generated": False}

# Fixed value: what a data-frame export writes for a blank header.
MARKER = "Unnamed"
# What Spark itself calls a blank header.
GENERATED = re.compile(r"_c\d+")


def unnamed(table: Table) -> DataFrame:
    generated = table.options[NAME]["match_generated"]
    found = [
        str(field.idx)
        for field in table.fields
        if MARKER in field.name or (generated and GENERATED.fullmatch(field.name))
    ]
    numbers = f"cast(array({', '.join(found)}) as array<int>)"
    return (
        one_row(table.spark)
        .selectExpr(f"explode({numbers}) as idx")
        .withColumn("column", table.name)
    )


def metrics(df: DataFrame, **options) -> DataFrame:
    """``(column)`` for every unnamed column; reads names, not data."""
    return unnamed(table_for(sys.modules[__name__], df, options)).select("column")


def lints(table: Table) -> DataFrame:
    return lint_rows(
        unnamed(table),
        occurrences="1",
        sample="array(column)",
        message="'column without a name of its own'",
    )


def findings(df: DataFrame, **options) -> DataFrame:
    return run(sys.modules[__name__], df, options)
