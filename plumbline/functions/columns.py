"""Naming and selecting columns.

Checks address columns by position (``c0``, ``c1`` ...), so a name may hold
dots, back-ticks or quotes, may be ``count``, and may occur twice. What is
repeated for every column is written as SQL text, because building a Column
object costs a few round trips to the JVM and tables can be wide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Field(NamedTuple):
    idx: int
    name: str
    type: T.DataType

    @property
    def col(self) -> str:
        return f"c{self.idx}"

    @property
    def number(self) -> str:
        """The value as a double; adding zero turns -0.0 into 0.0."""
        return f"cast({self.col} as double) + 0D"

    @property
    def text(self) -> str:
        if self.type == T.StringType():
            return self.col
        return f"cast({self.col} as string)"


def positional(df: DataFrame) -> tuple[DataFrame, list[Field]]:
    fields = [Field(i, f.name, f.dataType) for i, f in enumerate(df.schema)]
    return df.toDF(*[f.col for f in fields]), fields


def is_number(field: Field) -> bool:
    return isinstance(field.type, T.NumericType)


def is_string(field: Field) -> bool:
    return isinstance(field.type, T.StringType)


def is_value(field: Field) -> bool:
    """Columns that hold categories: strings and booleans."""
    return isinstance(field.type, (T.StringType, T.BooleanType))


def long_form(
    rows: DataFrame,
    fields: Iterable[Field],
    value: Callable[[Field], str],
    name: str,
    keep: Iterable[str] = (),
) -> DataFrame:
    """One ``(idx, <name>)`` row per row and column, nulls included."""
    fields = list(fields)
    keep = list(keep)
    wide = rows.selectExpr(*keep, *[f"{value(f)} as `{f.idx}`" for f in fields])
    long = wide.unpivot(keep, [str(f.idx) for f in fields], "idx", name)
    return long.selectExpr(*keep, "cast(idx as int) as idx", name)
