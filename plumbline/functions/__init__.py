"""Column expressions the checks are built from."""

from .columns import Field, is_number, is_string, is_value, long_form, positional
from .expressions import (
    fences,
    is_filled,
    is_numeric_text,
    outside,
    root_scale,
)

__all__ = [
    "Field",
    "fences",
    "is_filled",
    "is_number",
    "is_numeric_text",
    "is_string",
    "is_value",
    "long_form",
    "outside",
    "positional",
    "root_scale",
]
