"""Summaries of findings, and the report on disk."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import ERROR, FINDING_SCHEMA, LINT, OK


def summary(findings: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """One row: how many results, and how many of each status."""
    status = F.col("status")
    counts = [
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(status == OK).alias("total_ok"),
        F.count_if(status == LINT).alias("total_lints"),
        F.count_if(status == ERROR).alias("total_errors"),
    ]
    if elapsed_seconds is not None:
        counts.append(F.lit(round(float(elapsed_seconds), 2)).alias("elapsed_seconds"))
    return findings.agg(*counts)


def gate(findings: DataFrame) -> DataFrame:
    """One row: ``failed`` is true if anything is a lint or an error."""
    bad = F.col("status").isin(LINT, ERROR)
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"))


def report_lines(findings: DataFrame) -> DataFrame:
    """A text per finding: source, code, status and what was found where.

    A finding of a table that no file is known for has ``-`` as its source.
    """
    source = F.coalesce(F.concat_ws("/", "dataset", "file_name"), F.lit(""))
    what = F.concat_ws(": ", "column", "message")
    line = F.concat_ws(
        " | ", F.when(source == "", "-").otherwise(source), "code", "status", what
    )
    return findings.select(line.alias("line"))


def write_report(
    findings: DataFrame, path: str, elapsed_seconds: float | None = None
) -> None:
    """JSON lines under ``path/findings`` and ``path/summary``.

    The summary is taken from the written findings, so the checks run once.
    """
    target = path.rstrip("/")
    findings.write.mode("errorifexists").option("ignoreNullFields", False).json(
        f"{target}/findings"
    )
    written = findings.sparkSession.read.schema(FINDING_SCHEMA).json(
        f"{target}/findings"
    )
    summary(written, elapsed_seconds).write.mode("errorifexists").json(
        f"{target}/summary"
    )


def write_document(
    findings: DataFrame, path: str, elapsed_seconds: float | None = None
) -> None:
    """One JSON file: totals, time and ``results``, in the order of the findings.

    The checks run once, while the findings are written beside ``path``; how long
    that takes is ``elapsed_seconds``, unless the caller has measured more than
    that. The document is one row, as a report has few: one for each check and
    column of each file. It is written beside ``path`` as well and then renamed, so
    that readers see all of it or nothing. An existing file is left alone and told
    as an error.
    """
    spark = findings.sparkSession
    target = path.rstrip("/")
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(target)
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(file):
        raise FileExistsError(target)
    beside = f"{target}.{uuid.uuid4().hex}"
    try:
        started = time.perf_counter()
        order = F.monotonically_increasing_id().alias("order")
        findings.select("*", order).write.parquet(f"{beside}/findings")
        if elapsed_seconds is None:
            elapsed_seconds = time.perf_counter() - started
        written = spark.read.parquet(f"{beside}/findings")
        own = F.struct(*FINDING_SCHEMA.names)
        results = F.array_sort(F.collect_list(F.struct("order", own.alias("own"))))
        listed = written.agg(F.transform(results, lambda r: r["own"]).alias("results"))
        # One row each.
        totals = summary(written, elapsed_seconds).withColumn(
            "results", listed.scalar()
        )
        document = totals.select(
            F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        )
        document.coalesce(1).write.text(f"{beside}/document")
        (part,) = system.globStatus(
            jvm.org.apache.hadoop.fs.Path(f"{beside}/document/part-*")
        )
        if not system.rename(part.getPath(), file):
            raise OSError(f"cannot write {target}")
    finally:
        system.delete(jvm.org.apache.hadoop.fs.Path(beside), True)
