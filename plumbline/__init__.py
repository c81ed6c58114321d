"""Data-quality checks for Spark DataFrames."""

from .report import gate, report_lines, summary, write_document, write_report
from .schema import FINDING_SCHEMA
from .sources import read_dataset
from .suite import (
    available_checks,
    lint,
    lint_paths,
    register_check,
    unregister_check,
)

__all__ = [
    "FINDING_SCHEMA",
    "available_checks",
    "gate",
    "lint",
    "lint_paths",
    "read_dataset",
    "register_check",
    "report_lines",
    "summary",
    "unregister_check",
    "write_document",
    "write_report",
]
