"""The eight checks.

Each module has ``metrics(df, ...)``, typed measurements per column, and
``findings(df, ...)``, rows of ``FINDING_SCHEMA``. Both are lazy.
"""

from . import (
    case_variants,
    category_dominance,
    duplicate_rows,
    empty_columns,
    iqr_outliers,
    negative_values,
    numeric_text,
    unnamed_columns,
)

BUILT_IN = (
    unnamed_columns,
    empty_columns,
    category_dominance,
    duplicate_rows,
    case_variants,
    numeric_text,
    iqr_outliers,
    negative_values,
)

__all__ = [
    "BUILT_IN",
    "case_variants",
    "category_dominance",
    "duplicate_rows",
    "empty_columns",
    "iqr_outliers",
    "negative_values",
    "numeric_text",
    "unnamed_columns",
]
