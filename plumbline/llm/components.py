"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung under its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
    )


def _small_stars(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung under the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.withColumnRenamed("m", "b")).where("a <> b")


def _done(edges: DataFrame) -> bool:
    """Whether each node has one edge at most, to a node that has none."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("out")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node")
    nodes = nodes.agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return not nodes.where("n > 1 or n > least").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of an edge; the smallest node names it.

    Both steps keep components as they are and end when all edges point to the
    smallest node; the number of turns grows with the logarithm of the nodes.
    Every turn is written, so that none is done again for a lost executor.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(down.where("a <> b").distinct())
    while not _done(now):
        now = written(_small_stars(_stars(now)).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
