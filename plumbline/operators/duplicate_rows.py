"""DL004: rows that repeat an earlier row in every column."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.findings import lint_rows
from ..plans.table import Table
from .base import run, table_for

NAME = "duplicate_rows"
CODE = "DL004"
OK_MESSAGE = "all rows differ"
OPTIONS: dict = {}

SAMPLE_SIZE = 3
JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def counts(table: Table) -> DataFrame:
    """``(duplicate_groups, surplus)``: distinct repeated rows, copies too many."""
    return table.duplicates.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
    )


def metrics(df: DataFrame) -> DataFrame:
    return counts(table_for(sys.modules[__name__], df, {}))


def lints(table: Table) -> DataFrame:
    return lint_rows(
        counts(table).where("surplus > 0"),
        occurrences="surplus",
        message="'rows that repeat other rows'",
    )


def samples(table: Table) -> DataFrame | None:
    """The first few repeated rows as JSON, each with its count."""
    if not table.fields:
        return None
    row = F.struct(*[F.col(f.col).alias(f.name) for f in table.fields])
    text = F.to_json(F.struct(row.alias("row"), F.col("n").alias("count")), JSON)
    first = table.duplicates.select(text.alias("text")).orderBy("text")
    return first.limit(SAMPLE_SIZE).selectExpr(
        f"'{NAME}' as check", "-1 as idx", "array_sort(collect_list(text)) as sample"
    )


def findings(df: DataFrame) -> DataFrame:
    return run(sys.modules[__name__], df, {})
