"""Choosing checks and running them together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .operators import BUILT_IN
from .operators.base import settings
from .plans.findings import Part, assemble, part
from .plans.table import Table
from .schema import ERROR, ERROR_CODE, as_findings, finding_rows
from .sources import file_label, read_dataset
from .storage import ensure_checkpoint_dir

CHECKS = {module.NAME: module for module in BUILT_IN}
FILE_READ = "file_read"
# Files that are linted at the same time. Their jobs share the cluster; a small file
# leaves most of it idle between its many short stages.
FILES_AT_ONCE = 8


class Registered(NamedTuple):
    name: str
    code: str
    fn: Callable[..., DataFrame]


_registered: dict[str, Registered] = {}


def register_check(name: str, code: str, fn: Callable[..., DataFrame]) -> None:
    """Add a check of your own.

    ``fn(df, **options)`` returns one row per problem, or one OK row, with any
    of the columns of ``FINDING_SCHEMA``.
    """
    if name in CHECKS:
        raise ValueError(f"{name} is a built-in check")
    _registered[name] = Registered(name, code, fn)


def unregister_check(name: str) -> None:
    _registered.pop(name, None)


def available_checks() -> dict[str, str]:
    """Check names with their codes."""
    built_in = {name: module.CODE for name, module in CHECKS.items()}
    return built_in | {name: r.code for name, r in _registered.items()}


def lint(
    df: DataFrame,
    checks: Sequence[str] | None = None,
    *,
    options: dict[str, dict] | None = None,
    samples: bool = True,
    isolate: str = "plan",
    path: str | None = None,
) -> DataFrame:
    """Findings of the chosen checks, all eight by default, in that order.

    The result is lazy. A check whose plan cannot be built becomes an error
    row; with ``isolate="run"`` the checks are run at once, and one that fails
    then becomes an error row as well.
    """
    chosen = list(CHECKS) if checks is None else list(checks)
    if not chosen:
        raise ValueError("no checks chosen")
    if isolate not in ("plan", "run"):
        raise ValueError(f"unknown isolation: {isolate}")
    options = options or {}
    if isolate == "plan":
        found = _plan(df, chosen, options, samples)
    else:
        found = _run(df, chosen, options, samples)
    return found if path is None else as_findings(found, **file_label(path))


def lint_paths(
    spark: SparkSession,
    paths: Sequence[str],
    checks: Sequence[str] | None = None,
    *,
    schemas: dict[str, StructType | str] | None = None,
    isolate: str = "run",
    at_once: int = FILES_AT_ONCE,
    **kwargs,
) -> DataFrame:
    """Findings for every file, in their order; one that cannot be read becomes
    error rows.

    The files are linted as this is called, ``at_once`` of them at a time, so that a
    file that fails half way leaves the findings of the others alone: each has jobs
    of its own. With ``isolate="plan"`` nothing runs yet, and such a file fails them
    all.
    """
    if not paths:
        raise ValueError("no files given")
    if at_once < 1:
        raise ValueError(f"at_once cannot be {at_once}")

    def found(path: str) -> DataFrame:
        try:
            df = read_dataset(spark, path, (schemas or {}).get(path))
            return lint(df, checks, path=path, isolate=isolate, **kwargs)
        except Exception as e:
            row = _error(FILE_READ, f"unreadable: {e}")
            return finding_rows(spark, [row | file_label(path)])

    with ThreadPoolExecutor(min(at_once, len(paths))) as pool:
        # Threads have the properties of the caller's, such as its scheduler pool.
        started = [pool.submit(inheritable_thread_target(spark)(found), p) for p in paths]
        return reduce(DataFrame.unionByName, [each.result() for each in started])


def _plan(df: DataFrame, chosen: list[str], options: dict, samples: bool) -> DataFrame:
    """One plan in which the built-in checks share their passes."""
    spark = df.sparkSession
    failures: dict[str, str] = {}
    configured = {}
    for name in dict.fromkeys(chosen):
        if name in CHECKS:
            try:
                configured[name] = settings(CHECKS[name], options.get(name))
            except Exception as e:
                failures[name] = _failure(e)
    table = Table(df, configured, samples=samples)
    parts: list[Part] = []
    outputs: list[DataFrame] = []

    def flush():
        if not parts:
            return
        try:
            outputs.append(as_findings(assemble(table, parts)))
        except Exception as e:
            rows = [_error(p.check, _failure(e)) for p in parts]
            outputs.append(finding_rows(spark, rows))
        parts.clear()

    for position, name in enumerate(chosen):
        try:
            if name in failures:
                row = _error(name, failures[name])
                output = finding_rows(spark, [row])
            elif name in configured:
                parts.append(part(position, CHECKS[name], table))
                continue
            elif name in _registered:
                own = _registered[name]
                found = own.fn(df, **options.get(name, {}))
                output = as_findings(found, code=own.code, check=name)
            else:
                output = finding_rows(spark, [_error(name, "no check of this name")])
        except Exception as e:
            output = finding_rows(spark, [_error(name, _failure(e))])
        flush()
        outputs.append(output)
    flush()
    return reduce(DataFrame.unionByName, outputs)


def _run(df: DataFrame, chosen: list[str], options: dict, samples: bool) -> DataFrame:
    """Run now: the built-in checks together, each check of one's own alone.

    The built-in ones are run one by one only if their common plan fails; the
    first failure is told with those that fail again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)

    def run(names: list[str], note: str = "") -> DataFrame:
        try:
            return _plan(df, names, options, samples).checkpoint()
        except Exception as e:
            return finding_rows(spark, [_error(n, _failure(e) + note) for n in names])

    built_in = [n for n in dict.fromkeys(chosen) if n in CHECKS]
    alone: dict[str, DataFrame] = {}
    together = None
    if built_in:
        try:
            together = _plan(df, built_in, options, samples).checkpoint()
        except Exception as e:
            note = f" (together: {type(e).__name__})"
            alone = {n: run([n], note) for n in built_in}
    found = []
    for name in chosen:
        if name in CHECKS and together is not None:
            found.append(together.where(together["check"] == name))
        else:
            found.append(alone[name] if name in alone else run([name]))
    return reduce(DataFrame.unionByName, found)


def _failure(e: Exception) -> str:
    return f"failed: {e}"


def _error(check: str, message: str) -> dict:
    return {
        "code": ERROR_CODE,
        "check": check,
        "status": ERROR,
        "message": message,
    }
