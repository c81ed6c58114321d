"""Merkle manifest of a dataset by butterfly exchange.

Rows are leaves of one tree for each key (a source, say), in the order of their ids;
the trees' roots, in the order of the keys, are the leaves of a tree above. Every
run of ``FANOUT`` nodes is hashed into their parent until one is left.

A tree is cut into blocks of ``FANOUT ** BLOCK_LEVELS`` neighbouring leaves, and a
block hashes its own subtree. Then blocks swap roots round by round: in round ``r``
those whose numbers differ in digit ``r`` only, to the base ``FANOUT``, are a group,
in which everybody gets the others' roots, takes them into its proofs and hashes
the parent for itself. So each block learns its ancestors and their siblings on the
way up, and nothing is sent down again. The last subtree of a tree may have fewer
blocks than the others; it sends its root once for each group that would lack it.
A group has at most ``FANOUT`` members, whatever a key holds.

Each round is one window over the groups and is written, so that a lost executor
costs its running tasks only. Texts are hashed where they are read; what is shuffled
are ids and digests.

Defined results: a null id comes before all others and a null key before all keys;
rows of one key and id are ordered by their digests, equal ones are leaves each; a
null field hashes as ``-`` and is untouched by tampering; other columns are ignored;
an empty table has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 16
BLOCK_LEVELS = 3
# Keys up to this number travel to all executors with their proofs of some 6 KB.
BROADCAST_KEYS = 4000
DIGEST = 64  # hexadecimal figures

STEP = "struct<at: int, others: string>"
PROVEN = (
    "id string, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string"
)


def field(name: str) -> Column:
    """``-`` if null, else the number of bytes, a colon and the value."""
    value = F.col(name).cast("string")
    told = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    return F.coalesce(told, F.lit("-"))


def digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*fields), 256)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with ``rank`` in their tree and the tree's ``size``.

    Sorted by ranges over all trees, so that a large tree is spread over many
    tasks; a task's share of a tree is numbered on, from how many leaves of the
    tree the tasks before it hold. There are at most as many such shares as tasks
    and trees together.
    """
    # The last of the keys parts rows that are equal in all others.
    apart = leaves.withColumn("row", F.monotonically_increasing_id())
    keys = ["tree", *order, "row"]
    ordered = written(
        apart.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("row", F.monotonically_increasing_id())
        # The upper bits of such a number are the task.
        .withColumn("task", F.shiftright("row", 33))
    )
    shares = ordered.groupBy("tree", "task").agg(
        F.count("*").alias("n"), F.min("row").alias("first")
    )
    tree = Window.partitionBy("tree")
    ahead = F.sum("n").over(tree.orderBy("task")) - F.col("n")
    shares = shares.select(
        "tree",
        "task",
        (ahead - F.col("first")).alias("shift"),
        F.sum("n").over(tree).alias("size"),
    )
    return (
        ordered.join(shares, ["tree", "task"])
        .withColumn("rank", F.col("row") + F.col("shift"))
        .drop("row", "task", "shift")
    )


def above(nodes: str) -> str:
    """The parents of an array of nodes, in SQL."""
    return (
        f"transform(sequence(0, (size({nodes}) - 1) div {FANOUT}), i -> "
        f"sha2(array_join(slice({nodes}, i * {FANOUT} + 1, {FANOUT}), ''), 256))"
    )


def blocks(ranked: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row for each block: its leaves in order, and the root of its subtree.

    ``tree, block, blocks, levels, ids, leaves, claims, node``. Claims are what is
    to be checked, null where they are the leaf. A tree of one block ends at its
    root; other blocks are hashed through all ``levels``.
    """
    width = FANOUT**levels
    gathered = (
        ranked.withColumn("block", F.expr(f"rank div {width}"))
        .groupBy("tree", "block")
        .agg(
            F.max("size").alias("size"),
            F.array_sort(F.collect_list(F.struct("rank", "id", "leaf", "claim"))).alias("all"),
        )
        .selectExpr(
            "tree",
            "block",
            f"(size - 1) div {width} + 1 as blocks",
            "cast(all.id as array<string>) as ids",
            "all.leaf as leaves",
            "all.claim as claims",
            "all.leaf as nodes",
            "0 as levels",
        )
    )
    for _ in range(levels):
        # While several nodes remain, in the tree as a whole.
        more = "(blocks > 1 or size(nodes) > 1)"
        gathered = gathered.withColumns(
            {
                "nodes": F.expr(f"if({more}, {above('nodes')}, nodes)"),
                "levels": F.expr(f"levels + if({more}, 1, 0)"),
            }
        )
    return gathered.withColumn("node", F.get("nodes", F.lit(0))).drop("nodes")


def messages(states: DataFrame, span: int) -> DataFrame:
    """The roots that blocks send, ``own`` where to their own group.

    A block stands in a subtree of ``span`` blocks, or of fewer at the end of a
    tree. Its group is that of its place there (``seat``); the seats that a short
    subtree lacks are served by its blocks in turn.
    """
    first = f"block div {span} * {span}"
    there = f"cast(least({span}, blocks - {first}) as bigint)"
    alone = f"block div {span * FANOUT} * {span * FANOUT} = {first} and blocks - {first} <= {span}"
    seats = f"if({alone}, array(block % {span}), sequence(block % {span}, {span - 1}L, {there}))"
    return states.selectExpr(
        "*",
        f"block div {span * FANOUT} as party",
        f"cast(block div {span} % {FANOUT} as int) as digit",
        f"explode({seats}) as seat",
    ).withColumn("own", F.col("seat") == F.expr(f"block % {span}"))


def swapped(states: DataFrame, span: int) -> DataFrame:
    """One round: each block gets the roots of its group and hashes the parent."""
    group = Window.partitionBy("tree", "party", "seat")
    told = F.array_sort(F.collect_list(F.struct("digit", "node")).over(group))
    others = F.filter("told", lambda n: n["digit"] != F.col("digit"))
    step = F.struct(
        F.col("digit").alias("at"), F.array_join(others["node"], "").alias("others")
    )
    return (
        messages(states, span)
        .withColumn("told", told)
        .where("own")
        .select(
            "tree",
            "block",
            "blocks",
            F.sha2(F.array_join("told.node", ""), 256).alias("node"),
            F.concat("proof", F.array(step)).alias("proof"),
        )
    )


def exchange(found: DataFrame) -> DataFrame:
    """``tree, block, blocks, node, proof``: each block knows root and upper proof.

    The number of rounds is the logarithm of the largest tree's blocks.
    """
    states = found.select(
        "tree", "block", "blocks", "node", F.expr(f"cast(array() as array<{STEP}>)").alias("proof")
    )
    most = found.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        ready = states.where(F.col("blocks") <= span)
        states = written(
            swapped(states.where(F.col("blocks") > span), span).unionByName(ready)
        )
        span *= FANOUT
    return states


class Subtree:
    """The nodes of a block in Python; digests are bytes of hexadecimal figures."""

    def __init__(self, leaves: list[bytes], levels: int, proof: list):
        self.steps = [(at, others.encode()) for at, others in proof]
        self.runs = []
        nodes = leaves
        for _ in range(levels):
            runs = [
                b"".join(nodes[k : k + FANOUT]) for k in range(0, len(nodes), FANOUT)
            ]
            self.runs.append(runs)
            nodes = [sha256(run).hexdigest().encode() for run in runs]
        self.later: list[dict] = [{} for _ in range(levels + 1)]

    def siblings(self, leaf: int, level: int = 0) -> bytes:
        """The siblings of all levels from ``level`` up, left to right."""
        known = self.later[level]
        place = leaf // FANOUT**level
        if level == len(self.runs):
            return known.setdefault(0, b"".join(others for _, others in self.steps))
        if level and place in known:
            return known[place]
        run, at = self.runs[level][place // FANOUT], DIGEST * (place % FANOUT)
        found = run[:at] + run[at + DIGEST :] + self.siblings(leaf, level + 1)
        if level:
            known[place] = found
        return found

    def path(self, leaf: int):
        """``(place in the run, others)`` of every level."""
        for level, runs in enumerate(self.runs):
            place = leaf // FANOUT**level
            run, at = runs[place // FANOUT], place % FANOUT
            yield at, run[: DIGEST * at] + run[DIGEST * (at + 1) :]
        yield from self.steps

    def folded(self, leaf: int, claim: bytes) -> str:
        """The root as it follows from ``claim`` and the siblings."""
        node = claim
        for at, others in self.path(leaf):
            run = others[: DIGEST * at] + node + others[DIGEST * at :]
            node = sha256(run).hexdigest().encode()
        return node.decode()


def subtrees(batch: pd.DataFrame) -> Iterator:
    for row in batch.itertuples(index=False):
        leaves = [leaf.encode() for leaf in row.leaves]
        proof = [(step["at"], step["others"]) for step in row.proof]
        yield row, leaves, Subtree(leaves, row.levels, proof)


def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PROVEN.split(", ")]
    for batch in batches:
        for row, leaves, tree in subtrees(batch):
            rows = [
                (
                    id_,
                    leaves[k].decode(),
                    row.subroot,
                    row.root,
                    sha256(tree.siblings(k)).hexdigest(),
                    tree.folded(k, claim.encode() if claim else leaves[k]),
                )
                for k, (id_, claim) in enumerate(zip(row.ids, row.claims))
            ]
            yield pd.DataFrame(rows, columns=names)


def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row, leaves, tree in subtrees(batch):
            yield pd.DataFrame(
                {
                    "key": row.keys,
                    "root": row.node,
                    "proof": [
                        [{"at": at, "others": others.decode()} for at, others in tree.path(k)]
                        for k in range(len(leaves))
                    ],
                }
            )


class Manifest:
    """The trees of a dataset, held as written tables.

    ``leaves`` has a row for each block with its leaves; ``proofs`` has for each
    block the tree's root (``subroot``), the root of all and the ``proof`` from the
    block's node to it, a place and the others of the run for each level.
    """

    def __init__(self, leaves: DataFrame, proofs: DataFrame):
        self.leaves = leaves
        self.proofs = proofs

    def root(self) -> str | None:
        row = self.proofs.select("root").first()
        return row and row["root"]

    def audit(self) -> DataFrame:
        """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of all
        leaves: the root that follows from what each leaf is claimed to be."""
        found = self.leaves.join(self.proofs, ["tree", "block"])
        names = ["ids", "leaves", "claims", "levels", "proof", "subroot", "root"]
        proven = found.select(names).mapInPandas(prove, PROVEN)
        return proven.withColumns(
            {
                "id": F.col("id").cast("long"),
                "verified": F.col("folded_root") == F.col("root"),
            }
        )


def manifest(
    rows: DataFrame,
    id_: str,
    key: str,
    leaf: Column,
    claim: Column,
    levels: int = BLOCK_LEVELS,
) -> Manifest:
    """The trees over ``rows``, one for each ``key``, leaves by ``id_``.

    ``leaf`` is a row's digest and ``claim`` what another copy of it hashes to, or
    null where there is no doubt.
    """
    hashed = written(
        rows.select(
            # Before all others if null; else in the order of the bytes.
            F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")).alias("tree"),
            F.col(id_).cast("long").alias("id"),
            leaf.alias("leaf"),
            claim.alias("claim"),
        )
    )
    own = written(blocks(numbered(hashed, ["id", "leaf"]), levels))
    states = exchange(own)
    # The tree above, over the roots of the keys.
    roots = states.where("block = 0").select("tree", F.col("node").alias("leaf"))
    upper = numbered(
        written(
            roots.select(
                F.lit("").alias("tree"),
                F.col("tree").alias("key"),
                F.lit(None).cast("long").alias("id"),
                "leaf",
                F.lit(None).cast("string").alias("claim"),
            )
        ),
        ["key"],
    )
    keys = upper.groupBy("tree", F.expr(f"rank div {FANOUT**levels}").alias("block")).agg(
        F.expr("transform(array_sort(collect_list(struct(rank, key))), k -> k.key)").alias("keys")
    )
    top = written(blocks(upper, levels))
    known = (
        exchange(top)
        .join(top.select("tree", "block", "levels", "leaves"), ["tree", "block"])
        .join(keys, ["tree", "block"])
        .select("keys", "leaves", "levels", "proof", "node")
        .mapInPandas(spell, f"key string, root string, proof array<{STEP}>")
    )
    known = written(known.withColumnsRenamed({"key": "tree", "proof": "rest"}))
    if known.count() <= BROADCAST_KEYS:
        known = F.broadcast(known)
    proofs = states.join(known, "tree").select(
        "tree",
        "block",
        F.col("node").alias("subroot"),
        "root",
        F.concat("proof", "rest").alias("proof"),
    )
    return Manifest(own, written(proofs))
