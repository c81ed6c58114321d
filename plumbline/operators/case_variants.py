"""DL005: texts that occur in several capitalisations."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.findings import lint_rows
from ..plans.samples import smallest
from ..plans.table import Table
from ..plans.values import spellings
from .base import run, table_for

NAME = "case_variants"
CODE = "DL005"
OK_MESSAGE = "each text is spelt one way"
OPTIONS = {"columns": None}


def variants(table: Table) -> DataFrame | None:
    """``(idx, key, n, rows, first, last)`` for every text spelt several ways."""
    fields = table.text_fields(NAME)
    if not fields:
        return None
    return spellings(table.value_groups(NAME))


def surplus(found: DataFrame) -> DataFrame:
    return found.groupBy("idx").agg(
        F.expr("count(1) as variant_groups"),
        F.expr("sum(rows) as rows"),
        F.expr("sum(n - 1) as surplus"),
    )


def metrics(df: DataFrame, **options) -> DataFrame:
    """``(column, variant_groups, rows, surplus)`` for columns with variants."""
    table = table_for(sys.modules[__name__], df, options)
    found = variants(table)
    if found is None:
        return df.sparkSession.createDataFrame(
            [],
            "column string, variant_groups bigint, rows bigint, surplus bigint",
        )
    return surplus(found).select(
        table.name.alias("column"), "variant_groups", "rows", "surplus"
    )


def lints(table: Table) -> DataFrame | None:
    found = variants(table)
    if found is None:
        return None
    return lint_rows(
        surplus(found),
        occurrences="surplus",
        message="'texts that differ in capitals only'",
    )


def samples(table: Table) -> DataFrame | None:
    """The first and the last spelling of the first texts with several."""
    found = variants(table)
    if found is None:
        return None
    pairs = found.selectExpr(
        f"'{NAME}' as check", "idx", "key", "explode(array(first, last)) as value"
    )
    return smallest(pairs, ["key", "value"], "value", table.sample_size)


def findings(df: DataFrame, **options) -> DataFrame:
    return run(sys.modules[__name__], df, options)
