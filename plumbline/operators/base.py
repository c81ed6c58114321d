"""Running one check by itself."""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame

from ..plans.findings import assemble, part
from ..plans.table import Table
from ..schema import as_findings


def settings(check: ModuleType, given: dict | None) -> dict:
    given = given or {}
    unknown = set(given) - set(check.OPTIONS)
    if unknown:
        raise ValueError(
            f"{check.NAME} has no option {', '.join(sorted(unknown))}"
        )
    for name, valid in getattr(check, "VALID", {}).items():
        if name in given and not valid(given[name]):
            raise ValueError(f"{check.NAME}: {name} cannot be {given[name]!r}")
    return {**check.OPTIONS, **given}


def table_for(check: ModuleType, df: DataFrame, given: dict, samples=False) -> Table:
    return Table(df, {check.NAME: settings(check, given)}, samples=samples)


def run(check: ModuleType, df: DataFrame, given: dict) -> DataFrame:
    table = table_for(check, df, given, samples=True)
    return as_findings(assemble(table, [part(0, check, table)]))
