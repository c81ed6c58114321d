"""CSV and Parquet, chosen by extension."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """With a header; types are inferred in a pass of its own unless given."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


FORMATS = {".csv": read_csv, ".parquet": read_parquet}


def read_dataset(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
) -> DataFrame:
    """The whole file or directory."""
    extension = posixpath.splitext(path)[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"Unsupported format: {extension}")
    return FORMATS[extension](spark, path, schema)


def file_label(path: str) -> dict[str, str]:
    directory, name = posixpath.split(path)
    return {
        "dataset": posixpath.basename(directory),
        "file_name": name,
        "path": path,
    }
