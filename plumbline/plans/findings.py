"""From the offending columns of each check to its finished findings."""

from __future__ import annotations

from functools import reduce
from types import ModuleType
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LINT, OK, quoted
from .table import Table

LINT_TYPES = {
    "idx": "int",
    "status": "string",
    "occurrences": "bigint",
    "sample": "array<string>",
    "message": "string",
}
LINT_SCHEMA = ", ".join(f"{name} {type_}" for name, type_ in LINT_TYPES.items())


class Part(NamedTuple):
    """One check's share of a run."""

    position: int
    code: str
    check: str
    ok_message: str
    lints: DataFrame | None
    samples: DataFrame | None = None


def part(position: int, check: ModuleType, table: Table) -> Part:
    lints = check.lints(table)
    samples = None
    if table.samples and hasattr(check, "samples"):
        samples = check.samples(table)
    return Part(position, check.CODE, check.NAME, check.OK_MESSAGE, lints, samples)


def lint_rows(df: DataFrame, **values: str) -> DataFrame:
    """One row per problem, from SQL expressions over ``df``.

    ``idx`` is the offending column, -1 for the table as a whole. A sample that
    needs a pass of its own is left null here, to be joined on later.
    """
    given = {"status": quoted(LINT), "sample": "null"}
    given["idx"] = "idx" if "idx" in df.columns else "-1"
    given |= values
    return df.selectExpr(
        *[f"cast({given[n]} as {type_}) as {n}" for n, type_ in LINT_TYPES.items()]
    )


def assemble(table: Table, parts: list[Part]) -> DataFrame:
    """Every check's rows in order, or its single OK row where it has none.

    The rows number at most one per check and column, so one small list holds
    them all, and the choice between rows and OK row is made inside the plan.
    """
    frames = [
        p.lints.selectExpr(f"{p.position} as position", *LINT_TYPES)
        for p in parts
        if p.lints is not None
    ]
    if not frames:
        frames = [table.spark.createDataFrame([], f"position int, {LINT_SCHEMA}")]
    lints = reduce(DataFrame.unionByName, frames)
    items = with_samples(lints, parts).selectExpr(
        "array_sort(collect_list(struct(position, row))) as items"
    )
    headers = ", ".join(
        f"struct({p.position} as position, {quoted(p.code)} as code, "
        f"{quoted(p.check)} as check, {ok_row(p.ok_message)} as ok)"
        for p in parts
    )
    own = "transform(filter(items, i -> i.position = header.position), i -> i.row)"
    return (
        items.selectExpr("items", f"explode(array({headers})) as header")
        .selectExpr("header", f"{own} as own")
        .selectExpr(
            "header.code",
            "header.check",
            "inline(if(size(own) = 0, array(header.ok), own))",
        )
        .withColumn("column", table.name)
    )


def with_samples(lints: DataFrame, parts: list[Part]) -> DataFrame:
    """``(position, row)``, each row completed by its sample, or an empty one.

    Samples number as few as lints, hence the broadcast. A frame that serves
    several checks is joined once.
    """
    frames: dict[int, DataFrame] = {}
    users: dict[int, list[Part]] = {}
    for p in parts:
        if p.samples is not None and p.lints is not None:
            frames[id(p.samples)] = p.samples
            users.setdefault(id(p.samples), []).append(p)
    found = []
    for key, frame in frames.items():
        of = ", ".join(
            f"struct({quoted(p.check)} as check, {p.position} as position)"
            for p in users[key]
        )
        each = frame.selectExpr(
            "check as own",
            "idx as sample_idx",
            "sample as own_sample",
            f"inline(array({of}))",
        ).where("own = check")
        found.append(
            each.selectExpr("position as sample_position", "sample_idx", "own_sample")
        )
    sample = "sample"
    if found:
        samples = F.broadcast(reduce(DataFrame.unionByName, found))
        lints = lints.join(
            samples,
            (F.col("position") == F.col("sample_position"))
            & (F.col("idx") == F.col("sample_idx")),
            "left",
        )
        sample = "coalesce(sample, own_sample)"
    fields = [
        f"coalesce({sample}, array()) as sample" if name == "sample" else name
        for name in LINT_TYPES
    ]
    return lints.selectExpr("position", f"struct({', '.join(fields)}) as row")


def ok_row(message: str) -> str:
    values = {
        "idx": "-1",
        "status": quoted(OK),
        "occurrences": "0",
        "sample": "array()",
        "message": quoted(message),
    }
    fields = [f"cast({values[n]} as {t}) as {n}" for n, t in LINT_TYPES.items()]
    return f"struct({', '.join(fields)})"
