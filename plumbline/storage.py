"""Where intermediate results are kept."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session or its context names; all executors share it."""
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None)
    if named is None:
        named = context.getCheckpointDir()
    if not named:
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named
