"""Counters and sketches that one aggregate over the table can hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Field, is_filled, is_number, is_numeric_text, is_string
from ..schema import one_row
from .brackets import ends, sketch
from .sharing import unpack
from .values import Heavy

# Whole-stage code generation stops at 100 fields (spark.sql.codegen.maxFields),
# so an aggregate takes no more counters than this. Further columns go to
# another aggregate, which reads those columns alone.
COUNTERS_PER_PASS = 96

COUNTERS = ("nulls", "valid", "numeric", "negative")

# A sketch of a task takes up to some 100 KB, so sketches are merged in this many
# tasks before they meet in one.
MERGERS = 256


def counters_of(
    field: Field, wanted: frozenset[str], heavy: dict[int, Heavy]
) -> dict[str, str]:
    counters = {}
    if field.idx in heavy:
        counters["heavy"] = heavy[field.idx].sketch
    if "nulls" in wanted:
        counters["nulls"] = f"{field.col} is null"
    if "text" in wanted and is_string(field):
        counters["valid"] = is_filled(field.text)
        counters["numeric"] = is_numeric_text(field.text)
    if "negative" in wanted and is_number(field):
        counters["negative"] = f"{field.col} < 0"
    if "ends" in wanted and is_number(field):
        counters["sketch"] = sketch(field.number)
    return counters


def passes(
    fields: list[Field], wanted: frozenset[str], heavy: dict[int, Heavy]
) -> list[list]:
    groups: list[list] = [[]]
    room = COUNTERS_PER_PASS
    for field in fields:
        counters = counters_of(field, wanted, heavy)
        if not counters:
            continue
        if len(counters) > room:
            groups.append([])
            room = COUNTERS_PER_PASS
        groups[-1].append((field.idx, counters))
        room -= len(counters)
    return groups


def profile(
    rows: DataFrame,
    fields: list[Field],
    wanted: frozenset[str],
    heavy: dict[int, Heavy] | None = None,
) -> tuple[DataFrame, Column]:
    """``(idx, total, nulls, valid, numeric, negative, ends, keys)``, and the total.

    ``ends`` brackets the quartiles and ``keys`` are the hashes of all values that
    may be frequent, from sketches that the same aggregate holds. Both results come from the same scalar subquery, so several readers cost one
    pass. A column without a wanted counter or sketch has no row.
    """
    heavy = heavy or {}
    counted = [per_column(rows, group, heavy) for group in passes(fields, wanted, heavy)]
    cell = (
        reduce(DataFrame.unionByName, counted)
        .selectExpr(
            "struct(max(total) as total, "
            "filter(collect_list(struct(*)), r -> r.idx >= 0) as rows) as cell"
        )
        .scalar()
    )
    return unpack(rows.sparkSession, cell["rows"]), cell["total"]


def per_column(rows: DataFrame, group: list, heavy: dict[int, Heavy]) -> DataFrame:
    """The counters of one pass, a row per column and one for the table."""
    counts = {"total": "count(1)"}
    sketches: dict[str, tuple[str, ...]] = {}  # how made, made of nothing, and merged
    structs = []
    for idx, counters in [(-1, {}), *group]:
        values = []
        for name in COUNTERS:
            if name in counters:
                counts[f"{name}{idx}"] = f"count_if({counters[name]})"
                values.append(f"{name}{idx} as {name}")
            else:
                values.append(f"cast(null as bigint) as {name}")
        found, keys = ends(None), "cast(null as array<bigint>)"
        if "sketch" in counters:
            name = f"sketch{idx}"
            sketches[name] = (counters["sketch"], sketch("null"), f"kll_merge_agg_double({name})")
            found = ends(name)
        if "heavy" in counters:
            name = f"heavy{idx}"
            summary = heavy[idx]
            sketches[name] = (summary.sketch, summary.blank, summary.merged(name))
            keys = summary.keys(name)
        structs.append(
            f"struct({idx} as idx, total, {', '.join(values)}, {found} as ends, {keys} as keys)"
        )
    named = [f"{expr} as {name}" for name, expr in counts.items()]
    if sketches:
        # Blank sketches, as those of frequent items cannot be merged of none.
        blank = [f"0L as {name}" for name in counts]
        blank += [f"{none} as {name}" for name, (_, none, _) in sketches.items()]
        blank = one_row(rows.sparkSession).agg(*map(F.expr, blank))
        named += [f"{made} as {name}" for name, (made, _, _) in sketches.items()]
        first = rows.selectExpr("*", f"spark_partition_id() % {MERGERS} as merger")
        first = first.groupBy("merger").agg(*map(F.expr, named)).drop("merger")
        rows = first.unionByName(blank)
        named = [f"coalesce(sum({name}), 0) as {name}" for name in counts]
        named += [f"{merged} as {name}" for name, (_, _, merged) in sketches.items()]
    return rows.selectExpr(*named).selectExpr(f"inline(array({', '.join(structs)}))")
