"""Fixity audit of archived records with Merkle trees.

Records of a file are hashed in order, and runs of ``FANOUT`` neighbours are
hashed together, level by level, to one root a file. A node stands for a range
of offsets. Two replicas are compared from the roots down: only the children of
nodes that differ are looked at, so that a sound file costs one comparison.

A record is in the replica under the same file and number, or missing there.
Everything is joins and grouped aggregates; no group holds more than ``FANOUT``
rows, and a file's records are only counted and summed.

Defined results: a null payload is an empty one; a file that only one replica
has differs in all its records; rows of equal file and number are one leaf, told by
their number and the sums of their hashes; a null file is a file, a null number a
record of its own; an empty archive has no tree and no difference; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FANOUT = 16
LEVELS = 4


def warc_records(pages: DataFrame, per_file: int = 4096) -> DataFrame:
    """``file, number, record``: pages as WARC response records, in id order.

    Files take ``per_file`` successive ids; ``FANOUT ** LEVELS`` bounds it. Negative
    ids are in files of negative numbers, pages without id in a file without number.
    """
    if not 0 < per_file <= FANOUT**LEVELS:
        raise ValueError(f"per_file must be in 1 to {FANOUT**LEVELS}")
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.col("url"), F.lit(""))),
        F.concat(
            F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")
        ),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    return pages.select(
        F.expr(f"(page_id - pmod(page_id, {per_file})) div {per_file}").alias("file"),
        F.expr(f"cast(pmod(page_id, {per_file}) as int)").alias("number"),
        F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).alias("record"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """``file, level, number, hash, length``, a row for each record."""
    record = F.coalesce(F.col("record"), F.lit(""))
    # Parts of the hashes, summed: the same in any order, and of a fixed size.
    parts = [
        F.sum(F.conv(F.substring("hash", at, 15), 16, 10).cast("decimal(20,0)"))
        for at in (1, 16, 31, 46)
    ]
    return (
        records.select(
            "file",
            "number",
            F.sha2(record, 256).alias("hash"),
            F.octet_length(record).cast("long").alias("length"),
        )
        .groupBy("file", "number")
        .agg(
            F.concat_ws(":", F.count("*"), *parts).alias("hashes"),
            F.count("*").alias("n"),
            F.max("hash").alias("hash"),
            F.sum("length").alias("length"),
        )
        .select(
            "file",
            F.lit(0).alias("level"),
            "number",
            F.when(F.col("n") == 1, F.col("hash"))
            .otherwise(F.sha2("hashes", 256))
            .alias("hash"),
            "length",
        )
    )


def parents(nodes: DataFrame) -> DataFrame:
    """Nodes one level up: children hashed in order with their numbers."""
    child = F.struct("number", "hash")
    text = F.transform(
        F.array_sort(F.collect_list(child)),
        lambda c: F.concat_ws(
            ":", F.coalesce(c["number"].cast("string"), F.lit("-")), c["hash"]
        ),
    )
    return nodes.groupBy(
        "file",
        (F.col("level") + 1).alias("level"),
        F.expr(f"cast(number div {FANOUT} as int)").alias("number"),
    ).agg(
        F.sha2(F.array_join(text, "\n"), 256).alias("hash"),
        F.sum("length").alias("length"),
    )


def tree(records: DataFrame) -> DataFrame:
    """All nodes of all files, leaves at level 0 and roots at ``LEVELS``."""
    levels = [leaves(records)]
    for _ in range(LEVELS):
        levels.append(parents(levels[-1]))
    return reduce(DataFrame.unionByName, levels)


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Leaves that differ between two trees, found from the roots down.

    ``file, number, hash, length, other_hash, other_length``; null where a
    replica lacks the record.
    """
    def children(nodes: DataFrame, level: int, above: DataFrame | None) -> DataFrame:
        """The nodes of a level, but only below those that differ."""
        rows = nodes.where(F.col("level") == level).drop("level")
        if above is None:
            return rows
        up = F.expr(f"cast(number div {FANOUT} as int)")
        below = rows["file"].eqNullSafe(above["in_file"]) & up.eqNullSafe(above["up"])
        return rows.join(above, below, "left_semi")

    found = above = None
    for level in range(LEVELS, -1, -1):
        a = children(one, level, above)
        b = children(other, level, above)
        b = b.withColumnsRenamed({c: f"other_{c}" for c in b.columns})
        same = F.col("file").eqNullSafe(F.col("other_file"))
        same &= F.col("number").eqNullSafe(F.col("other_number"))
        found = (
            a.join(b, same, "full_outer")
            .where(~F.col("hash").eqNullSafe(F.col("other_hash")))
            .select(
                # A key that is null on both sides stays so.
                F.coalesce("file", "other_file").alias("file"),
                F.coalesce("number", "other_number").alias("number"),
                "hash",
                "length",
                "other_hash",
                "other_length",
            )
        )
        above = found.select(
            F.col("file").alias("in_file"), F.col("number").alias("up")
        )
    return found


def offsets(nodes: DataFrame) -> DataFrame:
    """``file, number, offset`` of each leaf, from the sums of what precedes.

    A leaf's offset is the sum of its elder siblings at every level.
    """
    from pyspark.sql import Window

    within = (
        Window.partitionBy("file", "level", F.expr(f"number div {FANOUT}"))
        .orderBy("number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = nodes.where(F.col("level") < LEVELS).withColumn(
        "ahead", F.coalesce(F.sum("length").over(within), F.lit(0))
    )
    found = ahead.where("level = 0").select("file", "number", "ahead")
    for level in range(1, LEVELS):
        up = ahead.where(F.col("level") == level).select(
            F.col("file").alias("in_file"),
            F.col("number").alias("up"),
            F.col("ahead").alias("more"),
        )
        place = F.expr(f"cast(number div {FANOUT**level} as int)")
        above = F.col("file").eqNullSafe(F.col("in_file")) & place.eqNullSafe(F.col("up"))
        found = (
            found.join(up, above)
            .select("file", "number", (F.col("ahead") + F.col("more")).alias("ahead"))
        )
    return found.withColumnRenamed("ahead", "offset")


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that are not the same in both replicas, with their offsets.

    ``file, number, offset, length, expected, found, fault``; offsets count in
    the file as it should be.
    """
    own, copied = written(tree(records)), written(tree(replica))
    wrong = differing(own, copied)
    fault = (
        F.when(F.col("other_hash").isNull(), "missing")
        .when(F.col("hash").isNull(), "added")
        .when(F.col("length") != F.col("other_length"), "resized")
        .otherwise("altered")
    )
    at = offsets(own).withColumnsRenamed({"file": "in_file", "number": "at"})
    same = F.col("file").eqNullSafe(F.col("in_file")) & F.col("number").eqNullSafe(F.col("at"))
    return (
        wrong.join(at, same, "left")
        .select(
            "file",
            "number",
            "offset",
            "length",
            F.col("hash").alias("expected"),
            F.col("other_hash").alias("found"),
            fault.alias("fault"),
        )
    )
