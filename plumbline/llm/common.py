"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
# Bits of a bitmap by which most rows that a join does not want are not shuffled.
SLOTS = 1 << 24
MAY = "may be among them"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a session of a single machine gets one of its own, and
    any other an error.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(SETTING, named)
    return named


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there.

    A lost executor costs the tasks that read from it and nothing before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are written."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(function):
    """``function`` for ``mapInPandas``, which gives memory back when a task ends.

    Python workers outlive their tasks, and what their allocators keep for later is
    lost to the executor's other processes.
    """

    def run(batches):
        import ctypes

        import pyarrow

        yield from function(batches)
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
        if trim:
            trim(0)

    return run


def cells(hashes: DataFrame, bits: int) -> DataFrame:
    """``cell, set``: a bit for each slot that a value of the only column falls in."""
    (name,) = hashes.columns
    slot = F.pmod(F.col(name), F.lit(bits)).alias("slot")
    return (
        hashes.select(slot)
        .groupBy(F.expr("cast(slot div 64 as int)").alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set"))
    )


def bitmap(hashes: DataFrame, bits: int):
    """The bits of ``cells`` in numpy.

    At most ``bits / 64`` rows come to the driver, whatever the table holds.
    """
    rows = cells(hashes, bits).toPandas()
    found = np.zeros(bits // 64, np.int64)
    found[rows["cell"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return found


def among(rows: DataFrame, hashed, wanted: DataFrame, bits: int = SLOTS) -> DataFrame:
    """``rows`` and, in ``MAY``, whether ``hashed`` may be a value of ``wanted``.

    True for all that are, and for others whose slot one of them falls into. What is
    broadcast are at most ``bits / 64`` rows, whatever the tables hold.
    """
    held = cells(wanted, bits).withColumnsRenamed({"cell": "cell of it", "set": "set of it"})
    own = rows.withColumn("slot of it", F.pmod(hashed, F.lit(bits)))
    own = own.join(
        F.broadcast(held), F.expr("cast(`slot of it` div 64 as int) = `cell of it`"), "left"
    )
    bit = F.getbit("set of it", F.expr("cast(`slot of it` % 64 as int)")) == 1
    return own.withColumn(MAY, F.coalesce(bit, F.lit(False))).drop(
        "slot of it", "cell of it", "set of it"
    )


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` but for those with the id and, in ``copy``, the hashed text of ``found``.

    Only the texts that a bitmap cannot tell from these are shuffled.
    """
    hashed = found.select(F.xxhash64("doc_id", "copy").alias("h"))
    told = among(docs, F.xxhash64("doc_id", F.xxhash64("text")), hashed)
    rest = told.where(F.col(MAY)).drop(MAY)
    gone = found.select(F.col("doc_id").alias("id of it"), F.col("copy").alias("copy of it"))
    same = F.expr("doc_id <=> `id of it` and xxhash64(text) = `copy of it`")
    rest = rest.join(gone, same, "left_anti")
    return told.where(~F.col(MAY)).drop(MAY).unionByName(rest)


def fold(column: str, folds: int):
    """crc32 of an integer column as text, modulo ``folds``; null is fold 0."""
    text = F.col(column).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % folds, F.lit(0))


def sampled(ids: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those whose hashed ``column`` is smallest.

    For fitting models only; the order does not follow the ids, so the sample
    is spread over the whole table.
    """
    order = F.xxhash64(F.col(column))
    return ids.orderBy(order, F.col(column)).limit(rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Python workers get at most ``rows`` rows at once for what runs within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
