"""The one shape every check reports in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

OK = "OK"
LINT = "LINT"
ERROR = "ERROR"

ERROR_CODE = "DL000"

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("occurrences", T.LongType()),
        T.StructField("sample", T.ArrayType(T.StringType())),
        T.StructField("message", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)

# What a check leaves out of its rows.
DEFAULTS = {"status": LINT, "occurrences": 0, "sample": []}


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value, data_type: T.DataType) -> str:
    if value is None:
        sql = "null"
    elif isinstance(value, (list, tuple)):
        items = [literal(v, data_type.elementType) for v in value]
        sql = f"array({', '.join(items)})"
    elif isinstance(value, str):
        sql = quoted(value)
    else:
        sql = str(value)
    return f"cast({sql} as {data_type.simpleString()})"


def finding_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Findings already known when the plan is built."""
    values = [
        tuple(row.get(f.name, DEFAULTS.get(f.name)) for f in FINDING_SCHEMA)
        for row in rows
    ]
    return spark.createDataFrame(values, FINDING_SCHEMA)


def as_findings(df: DataFrame, **fixed) -> DataFrame:
    """Project any frame onto FINDING_SCHEMA.

    ``fixed`` values win over the frame's columns; a column that neither has
    takes its default.
    """
    present = set(df.columns)
    columns = []
    for field in FINDING_SCHEMA:
        value = literal(
            fixed.get(field.name, DEFAULTS.get(field.name)), field.dataType
        )
        if field.name in present and field.name not in fixed:
            own = f"cast(`{field.name}` as {field.dataType.simpleString()})"
            value = f"coalesce({own}, {value})" if field.name in DEFAULTS else own
        columns.append(f"{value} as `{field.name}`")
    return df.selectExpr(*columns)


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(0, 1, 1, 1)
