"""Exact similarity join on word n-grams, and the groups it forms.

The universe of shingles is hashed into segments; how many depends on the band
of sizes (an octave) that the larger set of a pair falls in. Two sets that link
differ in at most ``H`` shingles, hence in at most ``H`` segments. Two ways to
index a band follow from that, and the cheaper one by estimated index rows and
chance candidates is allotted to it:

* segment subsets: the ``H + 1`` segments that come first in a common order,
  fullest first, must have one in common;
* one-deletion neighbourhoods: of ``(H + 1) / 2`` larger segments one differs
  by at most one shingle, so segments are indexed whole and with each of their
  shingles left out.

Candidates are verified on the shingles of their whole texts. Sets that are
equal are one node from the start. Pairs are never expanded within a bucket:

1. a node is compared with the one pivot that it shares most buckets with;
2. nodes still apart from the first or last node of a bucket are compared
   with it; what comes first differs from bucket to bucket, so that the nodes
   of a large group meet many pivots;
3. in buckets that hold several groups still, nodes outside the largest group
   are compared with the others, block by block, on their segments; of the pairs
   of different groups that their segments allow, one for each node is verified,
   its likeliest;
4. in buckets where a node has more such pairs, those of a block that hang
   together form a cluster. The texts of a cluster are compared in one task, all
   at once, and only the links that join its groups leave it: rows grow with the
   nodes, also where a large group of much alike texts does not link.

After that every pair that may link was compared or is joined already.

Defined results: a text with fewer words than ``words`` is one shingle; a null
or empty text, or one without words, has none and links with nothing; repeated
rows are joined like any equal sets, a null id counts as the largest; other
columns are ignored; an empty table gives an empty result. Sets and shingles
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAY, among, bitmap, release, small_batches, tidy, written
from .components import components
from .words import Hasher, chunks, mix

OCTAVES = 26
SPARE = 1.25
# How often a shingle of one text is also one of another that does not link with it.
CHANCE = 0.002
PAIR_COST = 4.0
BLOCK = 1024
# Characters whose shingles and segments are held at once, some 400 bytes for each.
HELD = 1 << 17
# Bytes of sketches that are compared at once, some two bytes for each.
COMPARED = 1 << 19
# Characters of a cluster's texts whose shingles are compared with as many others at
# once, and cells of the matrices in which they are, of 4 bytes.
MET = 1 << 21
CELLS = 1 << 22
FINE = 2
FILTER_BITS = 1 << 22
KEY_BITS = 1 << 25
# The index is grouped in so many slices of its keys, one after the other, so that
# only one is in the shuffle's files.
SLICES = 4


class Rule:
    """Link where ``100 * common >= percent * union``, on n-grams of ``words``."""

    def __init__(self, words: int = 4, percent: int = 85):
        self.words = words
        self.percent = percent
        # With fewer shingles only equal sets link.
        self.least = -(-percent // max(100 - percent, 1))

    def differ(self, both):
        """The most shingles that may be in one set only, given both sizes."""
        return both * (100 - self.percent) // (100 + self.percent)

    def largest(self, size):
        return size * 100 // self.percent

    def top(self, octave):
        return self.least * 2 ** (octave + 1) - 1

    def plan(self, octave: int, nodes: float) -> tuple[int, bool]:
        """Segments of an octave, and whether they get one-deletion keys."""
        most = int(self.differ(2 * self.top(octave)))
        size = self.top(octave) / 1.5
        exact = max(2, int(np.ceil(SPARE * (most + 1))))
        fewer = (most + 2) // 2
        chance = lambda content: nodes / 2 * CHANCE ** max(content, 1)
        subsets = (most + 1) * (1 + PAIR_COST * chance(size / exact))
        deletions = (fewer + size) * (1 + PAIR_COST * chance(size / fewer - 1))
        return (fewer, True) if deletions < subsets else (exact, False)


class Sets:
    """Shingle sets of some texts, laid end to end."""

    def __init__(self, hasher: Hasher, texts: list[str], words: int):
        doc, word, *_ = hasher.words(texts)
        n = len(texts)
        count = np.bincount(doc, minlength=n)
        gram = word
        for k in range(1, words):
            gram = mix(gram[: len(gram) - 1] * np.uint64(31) + word[k:]) if len(gram) > 1 else gram[:0]
        owner = doc[: len(gram)]
        if len(gram):
            whole = owner == doc[words - 1 :]
            owner, gram = owner[whole], gram[whole]
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            ends = np.cumsum(count)
            more = [
                hasher.runs(
                    word[ends[k] - count[k] : ends[k]].view(np.uint8), [0], [8 * count[k]]
                )[0]
                for k in short
            ]
            owner = np.concatenate([owner, short])
            gram = np.concatenate([gram, np.array(more, np.uint64)])
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        self.owner, self.gram = owner[new], gram[new]
        self.size = np.bincount(self.owner, minlength=n)
        self.edges = np.concatenate([[0], np.cumsum(self.size)])

    def of(self, k: int) -> np.ndarray:
        return self.gram[self.edges[k] : self.edges[k + 1]]

    def nodes(self) -> np.ndarray:
        """A hash of each set."""
        total = np.zeros(len(self.gram) + 1, np.uint64)
        np.cumsum(mix(self.gram + np.uint64(77)), out=total[1:])
        sums = total[self.edges[1:]] - total[self.edges[:-1]]
        return mix(sums + self.size.astype(np.uint64)).view(np.int64)


def octaves(rule: Rule, sizes: np.ndarray):
    """``(set, octave)``: the octaves whose larger sets each set may link with."""
    big = np.flatnonzero(sizes >= rule.least)
    own = np.log2(sizes[big] / rule.least).astype(np.int64)
    # Rounding at the edges of octaves.
    own += sizes[big] > rule.top(own)
    own -= sizes[big] < rule.least * 2**own
    up = rule.largest(sizes[big]) > rule.top(own)
    return np.concatenate([big, big[up]]), np.concatenate([own, own[up] + 1])


def segments(sets: Sets, plans, rule: Rule, chosen=None):
    """All segments of the sets in their octaves.

    ``(place, entry, octave, index, content, sum)`` by segment, where an entry
    is a set in an octave, and ``(segment, value)`` of each shingle.
    """
    entry_set, octave = octaves(rule, sets.size)
    m = np.array([p[0] for p in plans], np.int64)[octave]
    first = np.concatenate([[0], np.cumsum(m)])
    size = sets.size[entry_set]
    shingle = np.repeat(sets.edges[entry_set], size) + (
        np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    )
    value = mix(sets.gram[shingle] + np.uint64(5))
    at = np.repeat(first[:-1], size) + (
        value % np.repeat(m, size).astype(np.uint64)
    ).astype(np.int64)
    content = np.bincount(at, minlength=first[-1])
    order = np.argsort(at, kind="stable")
    total = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(value[order], out=total[1:])
    ends = np.cumsum(content)
    sums = total[ends] - total[ends - content]
    entry = np.repeat(np.arange(len(m)), m)
    index = np.arange(first[-1]) - np.repeat(first[:-1], m)
    return entry_set, octave, entry, index, content, sums, at, value


def key_of(octave, index, content, sums):
    """64-bit key of a segment; the octave stays in its last bits."""
    h = mix(sums + mix(index.astype(np.uint64) * np.uint64(1 << 20) + content.astype(np.uint64)))
    return (h & ~np.uint64(31)) | octave.astype(np.uint64)


def index_keys(sets: Sets, plans, rule: Rule):
    """``(set, key)``: the index entries of every set."""
    entry_set, octave, entry, index, content, sums, at, value = segments(sets, plans, rule)
    key = key_of(octave[entry], index, content, sums)
    one = np.array([p[1] for p in plans], bool)[octave]
    size = sets.size[entry_set]
    partner = np.minimum(rule.largest(size), rule.top(octave))
    need = rule.differ(size + partner) + 1
    # Fullest first; equal keys stand at equal places in this order.
    order = np.lexsort((key, -content, entry))
    m = np.bincount(entry, minlength=len(entry_set))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(m) - m, m)
    use = order[(rank < need[entry[order]]) | one[entry[order]]]
    owners, keys = [entry_set[entry[use]]], [key[use]]
    if one.any():
        less = one[entry[at]]
        a = at[less]
        keys.append(key_of(octave[entry[a]], index[a], content[a] - 1, sums[a] - value[less]))
        owners.append(entry_set[entry[a]])
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


# -- passes over the texts ---------------------------------------------------


def indexer(rule: Rule, plans):
    """``doc_id, copy, n_shingles, node, keys`` of every text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for first, last in chunks(texts, HELD):
                sets = Sets(hasher, texts[first:last], rule.words)
                nodes, sizes = sets.nodes(), sets.size.copy()
                # Equal sets are indexed once by each task.
                for k, node in enumerate(nodes.tolist()):
                    if node in seen:
                        sets.size[k] = 0
                    seen.add(node)
                owner, key = index_keys(sets, plans, rule)
                key = key[np.argsort(owner, kind="stable")]
                ends = np.cumsum(np.bincount(owner, minlength=last - first))
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[first:last].to_numpy(),
                        "copy": batch["copy"].iloc[first:last].to_numpy(),
                        "n_shingles": sizes,
                        "node": nodes,
                        "keys": np.split(key, ends[:-1]),
                    }
                )

    return find


def verifier(rule: Rule):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            one, other = list(batch["text_a"]), list(batch["text_b"])
            keep = np.zeros(len(one), bool)
            for first, last in chunks([a + b for a, b in zip(one, other)], HELD):
                a = Sets(hasher, one[first:last], rule.words)
                b = Sets(hasher, other[first:last], rule.words)
                for k in range(last - first):
                    common = len(np.intersect1d(a.of(k), b.of(k), assume_unique=True))
                    union = a.size[k] + b.size[k] - common
                    keep[first + k] = 100 * common >= rule.percent * union
            yield batch.loc[keep, ["a", "b"]]

    return verify


def screener(rule: Rule):
    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one, other = batch["sketch_a"].to_numpy(), batch["sketch_b"].to_numpy()
            size = batch["sketch_a"].map(len).to_numpy()
            apart = np.zeros(len(batch), np.int64)
            for m in np.unique(size):
                same = np.flatnonzero(size == m)
                step = max(1, COMPARED // int(m))
                for at in range(0, len(same), step):
                    some = same[at : at + step]
                    apart[some] = least_apart(laid(one[some]), laid(other[some]))
            a, b = batch["size_a"].to_numpy(), batch["size_b"].to_numpy()
            may = apart <= rule.differ(a + b)
            may &= 100 * np.minimum(a, b) >= rule.percent * np.maximum(a, b)
            yield batch.loc[may, ["a", "b"]]

    return screen


def sketcher(rule: Rule):
    """``node, octave, size, sketch``: a byte for each of many fine segments.

    Its last bit tells whether the segment holds an odd number of shingles, so that of
    segments that differ those with as many tell two shingles that do. With segments
    of one or two shingles hardly a pair passes that does not link.
    """
    plans = [
        (int(FINE * (rule.differ(2 * rule.top(k)) + 1)), False) for k in range(OCTAVES)
    ]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            texts = list(batch["text"])
            for first, last in chunks(texts, HELD):
                sets = Sets(hasher, texts[first:last], rule.words)
                entry_set, octave, entry, index, content, sums, *_ = segments(
                    sets, plans, rule
                )
                key = key_of(octave[entry], index, content, sums) >> np.uint64(57)
                key = key * np.uint64(2) + (content & 1).astype(np.uint64)
                m = np.bincount(entry, minlength=len(entry_set))
                parts = np.split(key.astype(np.uint8), np.cumsum(m)[:-1])
                own = batch["node"].to_numpy()[first:last]
                yield pd.DataFrame(
                    {
                        "node": own[entry_set],
                        "octave": octave,
                        "size": sets.size[entry_set],
                        "sketch": [p.tobytes() for p in parts[: len(entry_set)]],
                    }
                )

    return find


def ones(bits: np.ndarray) -> np.ndarray:
    """How many bits are set in each row of packed ``bits``, whose length is a multiple of 8."""
    words = np.bitwise_count(bits.view(np.uint64))
    found = words[..., 0].astype(np.int64)
    for k in range(1, words.shape[-1]):
        found += words[..., k]
    return found


def laid(sketches) -> np.ndarray:
    """Sketches of one length as rows, filled up to a multiple of 64 bytes."""
    sketches = list(sketches)
    size = len(sketches[0])
    found = np.zeros((len(sketches), max(64, -(-size // 64) * 64)), np.uint8)
    found[:, :size] = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), size)
    return found


def least_apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least number of shingles in one set only, of each pair of sketches.

    Bytes that differ are of segments that differ: by one shingle at least, and by two
    where their last bits, which tell odd sizes, are the same.
    """
    apart = one ^ other
    return 2 * ones(np.packbits(apart, axis=-1)) - ones(np.packbits(apart & 1, axis=-1))


def compared(rule: Rule, rows: pd.DataFrame):
    """``left, right, apart``: places in whole blocks of pairs that may link, from their
    sketches, and how many shingles at least these differ by, some of the pairs at a time.

    ``rows`` are sorted by block, those that are set aside, which are ``left``, last in
    each. The sketches of a block have one length; some are compared with all at once.
    """
    block = rows[["key", "i", "j"]].to_numpy()
    new = np.append(True, (block[1:] != block[:-1]).any(1))
    start = np.flatnonzero(new[: len(rows)])
    aside = rows["aside"].to_numpy(bool)
    sketch = rows["sketch"].to_numpy()
    group, count = rows["component"].to_numpy(), rows["size"].to_numpy()
    held, found = 0, []
    for first, last in zip(start, np.append(start[1:], len(rows))):
        own = first + np.flatnonzero(aside[first:last])
        others = np.arange(first, last - len(own))
        if not len(own) or not len(others):
            continue
        one, other = laid(sketch[own]), laid(sketch[others])
        parity = np.packbits(one & 1, axis=-1), np.packbits(other & 1, axis=-1)
        step = max(1, COMPARED // other.size)
        for at in range(0, len(own), step):
            left = own[at : at + step, None]
            both = count[left] + count[others]
            apart = 2 * ones(np.packbits(one[at : at + step, None] ^ other, axis=-1))
            apart -= ones(parity[0][at : at + step, None] ^ parity[1])
            use = (apart <= rule.differ(both)) & (group[left] != group[others])
            small = np.minimum(count[left], count[others])
            use &= 100 * small >= rule.percent * (both - small)
            a, b = np.nonzero(use)
            if len(a):
                found.append((left[a, 0], others[b], apart[use]))
                held += len(a)
            if held > COMPARED // 8:
                yield tuple(map(np.concatenate, zip(*found)))
                held, found = 0, []
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def allowed(rule: Rule, rows: pd.DataFrame, nearest: bool) -> pd.DataFrame:
    """Pairs of whole blocks that may link, from their sketches.

    With ``nearest``, of each node that is set aside only the likeliest pair, its
    bucket in ``key`` and whether the node had ``more`` pairs there.
    """
    node, key = rows["node"].to_numpy(), rows["key"].to_numpy()
    found = []
    for left, right, apart in compared(rule, rows):
        if nearest:
            order = np.lexsort((node[right], apart, left))
            left, right = left[order], right[order]
            heads = np.flatnonzero(np.append(True, left[1:] != left[:-1])[: len(left)])
            more = np.diff(np.append(heads, len(left))) > 1
            left, right = left[heads], right[heads]
        pair = np.sort(np.stack([node[left], node[right]], 1), axis=1)
        found.append(np.column_stack([pair, key[left], more]) if nearest else pair)
    names = ["a", "b", "key", "more"] if nearest else ["a", "b"]
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, len(names)), np.int64)
    return pd.DataFrame(pairs, columns=names)


def clusters(rule: Rule, rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of whole blocks with a pair that may link, by the ``cluster`` of such pairs.

    A row for each node of a block, however many pairs it has, and on which sides of
    them it stands. Clusters of the same nodes have the same number in all blocks.
    """
    rows = rows.reset_index(drop=True)
    both = sides(rows)
    place = both.index.to_numpy()
    label = np.arange(len(rows))
    every, aside = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    for left, right, _ in compared(rule, both):
        left, right = place[left], place[right]
        aside[left], every[right] = True, True
        while (label[left] != label[right]).any():
            # The larger of two ends is hung under the smaller; then ends are found.
            high = np.maximum(label[left], label[right])
            np.minimum.at(label, high, np.minimum(label[left], label[right]))
            while (label != label[label]).any():
                label = label[label]
    rows = rows.assign(every=every, aside=aside)
    # Nodes with the sides they stand on, summed up to the number of their cluster.
    node = rows["node"].to_numpy(np.int64).view(np.uint64)
    sums = np.zeros(len(rows), np.uint64)
    np.add.at(sums, label, mix(node * np.uint64(4) + every * np.uint64(2) + aside))
    rows["cluster"] = mix(sums)[label].view(np.int64)
    return rows.loc[every | aside, ["cluster", "node", "component", "every", "aside"]]


def sides(rows: pd.DataFrame) -> pd.DataFrame:
    """Each row for each side of its block that it stands on, those set aside last."""
    block = rows[["key", "i", "j"]].to_numpy()
    number = np.cumsum(np.append(True, (block[1:] != block[:-1]).any(1)))
    one, other = np.flatnonzero(rows["every"]), np.flatnonzero(rows["aside"])
    at = np.concatenate([one, other])
    aside = np.repeat([False, True], [len(one), len(other)])
    order = np.lexsort((aside, number[at]))
    return rows.iloc[at[order]].assign(aside=aside[order])


def whole_blocks(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows in runs of whole blocks, which have the same ``names``."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        # The last block may go on in the next batch.
        last = rows[names].to_numpy()
        whole = int((last != last[-1]).any(1).sum())
        held = rows.iloc[whole:]
        if whole:
            yield rows.iloc[:whole]
    if held is not None:
        yield held


def blocks_compared(rule: Rule, nearest: bool):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_blocks(batches, ["key", "i", "j"]):
            yield allowed(rule, sides(rows), True) if nearest else clusters(rule, rows)

    return compare


def shingled(rule: Rule, hasher: Hasher, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``size, gram``: the shingle sets of the texts, laid end to end."""
    found = []
    for first, last in chunks(texts, HELD):
        sets = Sets(hasher, texts[first:last], rule.words)
        found.append((sets.size, sets.gram))
    sizes, grams = zip(*found)
    return np.concatenate(sizes), np.concatenate(grams)


def in_common(one, other) -> np.ndarray:
    """How many shingles each set of ``one`` has in common with each of ``other``.

    A product of matrices with a column for each shingle, a few columns at a time.
    """
    (size_a, gram_a), (size_b, gram_b) = one, other
    shared = np.intersect1d(gram_a, gram_b)
    entries = []
    for size, gram in (one, other):
        at = np.minimum(np.searchsorted(shared, gram), max(len(shared) - 1, 0))
        use = np.flatnonzero(shared[at] == gram) if len(shared) else at[:0]
        use = use[np.argsort(at[use], kind="stable")]
        entries.append((np.repeat(np.arange(len(size)), size)[use], at[use]))
    total = np.zeros((len(size_a), len(size_b)), np.int64)
    width = max(1, CELLS // (len(size_a) + len(size_b)))
    for start in range(0, len(shared), width):
        part = []
        for size, (row, column) in zip((size_a, size_b), entries):
            cells = np.zeros((len(size), min(width, len(shared) - start)), np.float32)
            first, last = np.searchsorted(column, [start, start + width])
            cells[row[first:last], column[first:last] - start] = 1
            part.append(cells)
        total += (part[0] @ part[1].T).astype(np.int64)
    return total


def cluster_links(rule: Rule, hasher: Hasher, rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links that join the groups of a cluster, one for each that is joined to others."""
    node, text = rows["node"].tolist(), rows["text"].to_numpy()
    group = rows["component"].to_numpy().copy()
    every, aside = np.flatnonzero(rows["every"]), np.flatnonzero(rows["aside"])
    found = []
    for first, last in chunks(text[aside].tolist(), MET):
        left = aside[first:last]
        one = shingled(rule, hasher, text[left].tolist())
        for at, end in chunks(text[every].tolist(), MET):
            right = every[at:end]
            other = shingled(rule, hasher, text[right].tolist())
            common = in_common(one, other)
            union = one[0][:, None] + other[0] - common
            for k, link in zip(left, 100 * common >= rule.percent * union):
                hit = right[link & (group[right] != group[k])]
                joined, heads = np.unique(group[hit], return_index=True)
                found += [(node[k], node[h]) for h in hit[heads]]
                group[np.isin(group, joined)] = group[k]
    return found


def linker(rule: Rule):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for rows in whole_blocks(batches, ["cluster"]):
            found = []
            for _, cluster in rows.groupby("cluster", sort=False):
                found += cluster_links(rule, hasher, cluster)
            pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
            yield pd.DataFrame(pairs, columns=["a", "b"])

    return link


# -- the join ----------------------------------------------------------------


class Join:
    def __init__(self, docs: DataFrame, rule: Rule):
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
        self.rule = rule
        self.spark = docs.sparkSession
        # As if all documents were of one octave, for none has more.
        total = docs.count()
        self.plans = [rule.plan(k, total) for k in range(OCTAVES)]
        self.sets = written(
            self.docs.mapInPandas(
                tidy(indexer(rule, self.plans)),
                "doc_id long, copy long, n_shingles long, node long, keys array<long>",
            )
        )
        self.nodes = self.sets.drop("keys")

    def live(self) -> tuple[DataFrame, DataFrame]:
        """Buckets of more than one node, and the members of larger ones.

        ``key, low, high, n``, and ``key, node, low, high`` where ``n`` is over
        two; a bitmap of fixed size keeps most other keys from being shuffled.
        Nodes are ordered by their bits changed by the key's.
        """
        place = F.col("node").bitwiseXOR(F.col("key"))
        index = self.sets.select(F.explode("keys").alias("key"), "node")
        slices = []
        for k in range(SLICES):
            slices.append(
                written(
                    index.where(F.expr(f"pmod(shiftright(key, 5), {SLICES}) = {k}"))
                    .groupBy("key")
                    .agg(
                        F.min(place).alias("low"),
                        F.max(place).alias("high"),
                        F.count("*").alias("n"),
                    )
                    .where("low < high")
                    .withColumns(
                        {c: F.col(c).bitwiseXOR(F.col("key")) for c in ("low", "high")}
                    )
                )
            )
            release(self.spark)
        heads = reduce(DataFrame.unionByName, slices)
        large = heads.where("n > 2")
        held = self.spark.sparkContext.broadcast(bitmap(large.select("key"), KEY_BITS))

        @F.pandas_udf("array<long>")
        def marked(keys: pd.Series) -> pd.Series:
            found = []
            for k in keys:
                at = np.asarray(k, np.int64) & (KEY_BITS - 1)
                found.append(k[(held.value[at >> 6] >> (at & 63)) & 1 == 1])
            return pd.Series(found)

        members = self.sets.select(F.explode(marked("keys")).alias("key"), "node")
        return heads, written(members.join(large.drop("n"), "key"))

    def texts(self, wanted: DataFrame) -> DataFrame:
        """``node, text`` of the nodes ``wanted``, from one document of each.

        A bitmap of fixed size over the documents' hashed ids keeps most other
        texts from being shuffled.
        """
        one = (
            self.nodes.groupBy("node")
            .agg(F.min(F.struct("doc_id", "copy")).alias("of"))
            .join(wanted.distinct(), "node", "left_semi")
            .select("node", "of.*")
        )
        one = written(one)
        hashed = F.xxhash64("doc_id", "copy")
        docs = among(self.docs, hashed, one.select(hashed.alias("h"))).where(F.col(MAY))
        same = docs["doc_id"].eqNullSafe(one["doc_id"]) & (docs["copy"] == one["copy"])
        return docs.join(one, same).select("node", "text")

    def candidates(self, wanted: DataFrame) -> DataFrame:
        found = written(
            self.texts(wanted).mapInPandas(
                tidy(checker(self.rule)), "node long, text string"
            )
        )
        # Only documents that occur more than once give a node again.
        n = found.agg(F.count("*") > F.countDistinct("node")).first()[0]
        return written(found.dropDuplicates(["node"])) if n else found

    def screened(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs that the sizes and segments of their sets allow to link."""
        names = ("size", "sketch")
        a = sketches.withColumnsRenamed({"node": "a"} | {n: f"{n}_a" for n in names})
        b = sketches.withColumnsRenamed({"node": "b"} | {n: f"{n}_b" for n in names})
        both = pairs.select("a", "b", "octave").join(a, ["a", "octave"])
        both = both.join(b, ["b", "octave"])
        return both.mapInPandas(screener(self.rule), "a long, b long").distinct()

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        texts = among(texts, F.col("node"), ends, FILTER_BITS).where(F.col(MAY))
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.select("a", "b").join(a, "a").join(b, "b")
        return written(both.mapInPandas(tidy(verifier(self.rule)), "a long, b long"))

    def linked(self, nodes: DataFrame, texts: DataFrame) -> DataFrame:
        """Links that join the groups of each cluster of ``nodes``."""
        texts = among(texts, F.col("node"), nodes.select("node"), FILTER_BITS).where(F.col(MAY))
        rows = nodes.join(texts.drop(MAY), "node").repartition("cluster")
        rows = rows.sortWithinPartitions("cluster")
        return written(rows.mapInPandas(tidy(linker(self.rule)), "a long, b long"))


def checker(rule: Rule):
    """Texts whose set is the node they were fetched for."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            keep = []
            for first, last in chunks(texts, HELD):
                keep.append(Sets(hasher, texts[first:last], rule.words).nodes())
            if texts:
                same = np.concatenate(keep) == batch["node"].to_numpy()
                yield batch.loc[same, ["node", "text"]]

    return check


def grouped(nodes: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """``nodes`` with the group of the node in ``column``; itself if alone."""
    named = groups.select(F.col("node").alias(column), "component")
    joined = nodes.join(named, column, "left")
    return joined.withColumn("component", F.coalesce("component", F.col(column)))


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different groups."""
    one = grouped(pairs, groups, "a").withColumnRenamed("component", "group_a")
    both = grouped(one, groups, "b")
    return both.where(F.col("group_a") != F.col("component")).drop("group_a", "component")


def residual(
    join: Join,
    members: DataFrame,
    groups: DataFrame,
    sketches: DataFrame,
    nearest: bool,
):
    """Pairs of different groups in one bucket that their sketches allow.

    With ``nearest``, the likeliest of each node in a bucket, with the bucket's
    ``key`` and whether there are ``more``; otherwise the nodes of all pairs, by
    ``cluster``.
    """
    rows = grouped(members.select("key", "node").distinct(), groups, "node")
    shares = rows.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")
    )
    chief = shares.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("chief"),
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.max("n").alias("most"),
        F.bit_xor("mark").alias("mark"),
    )
    # Of three nodes the first and the last were compared with all others, and
    # of buckets with the same nodes one is enough.
    octave = F.expr("key & 31").alias("octave")
    open_ = chief.where("groups > 1 and n > 3").groupBy("mark", "n", octave)
    open_ = open_.agg(F.min_by(F.struct("*"), "key").alias("of")).select("of.*")
    open_ = open_.select(
        "key",
        "chief",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("asides"),
    )
    rows = written(rows.join(open_, "key").withColumn("octave", F.expr("key & 31")))
    rows = rows.join(sketches, ["node", "octave"])
    block = lambda n: F.expr(f"pmod(xxhash64(node), {n})").cast("int")
    # A node meets the set aside of every block from its own block, and set aside
    # itself all blocks; where both are one block it is sent there once.
    out = F.col("component") != F.col("chief")
    other = F.when(out, F.col("blocks") - 1).otherwise(0)
    units = rows.select(
        "*",
        block("blocks").alias("block"),
        block("asides").alias("place"),
        out.alias("out"),
        F.explode(F.sequence(F.lit(0), F.col("asides") - 1 + other)).alias("turn"),
    )
    every = F.col("turn") < F.col("asides")
    units = units.select(
        "key",
        F.when(every, F.col("block"))
        .otherwise(F.expr("cast(pmod(block + 1 + turn - asides, blocks) as int)"))
        .alias("i"),
        F.when(every, F.col("turn")).otherwise(F.col("place")).alias("j"),
        "node",
        "component",
        "size",
        "sketch",
        every.alias("every"),
        (F.col("out") & (~every | (F.col("turn") == F.col("place")))).alias("aside"),
    )
    columns = "cluster long, node long, component long, every boolean, aside boolean"
    if nearest:
        columns = "a long, b long, key long, more long"
    found = (
        units.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInPandas(tidy(blocks_compared(join.rule, nearest)), columns)
    )
    return found.distinct()


def ngram_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    with small_batches(docs.sparkSession):
        named = _groups(docs, words, percent)
    some = F.col("n_shingles") > 0
    least = named.where(some).groupBy("component").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "component", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(some, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def ngram_firsts(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, copy, n, first`` of each document: how often it occurs, and whether
    it is the first of its group.

    That is the one with the least id, of those the one with the least ``copy``, which
    is the ``xxhash64`` of its text; a null id counts as the largest. Each document
    without words is a group of its own.
    """
    with small_batches(docs.sparkSession):
        named = _groups(docs, words, percent)
    some = F.col("n_shingles") > 0
    each = named.groupBy("component", some.alias("some"), "doc_id", "copy").agg(
        F.count("*").alias("n")
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "copy")
    firsts = (
        each.where("some")
        .groupBy("component")
        .agg(F.min_by(F.struct("doc_id", "copy"), order).alias("of"))
        .select("of.*", F.lit(True).alias("first"))
    )
    same = each["doc_id"].eqNullSafe(firsts["doc_id"]) & (each["copy"] == firsts["copy"])
    return each.join(firsts, same, "left").select(
        each["doc_id"], each["copy"], "n", (F.col("first").isNotNull() | ~F.col("some")).alias("first")
    )


def _groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, doc_id, copy, n_shingles, component`` of every document."""
    join = Join(docs, Rule(words, percent))
    spark = join.spark
    heads, members = join.live()
    release(spark)
    ends = [("low", "high"), ("node", "low"), ("node", "high")]
    pairs = written(
        reduce(
            DataFrame.unionByName,
            [
                (heads if k == 0 else members).select(
                    F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "key"
                )
                for k, (x, y) in enumerate(ends)
            ],
        )
        .where("a <> b")
        .groupBy("a", "b", F.expr("key & 31").alias("octave"))
        .agg(F.count("*").alias("n"))
    )
    release(spark)
    texts = join.candidates(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sketches = written(
        texts.mapInPandas(
            tidy(sketcher(join.rule)),
            "node long, octave long, size long, sketch binary",
        )
    )
    release(spark)
    # The pivot with which a node shares most.
    best = (
        pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "octave", "n")
        .groupBy("node")
        .agg(
            F.max_by(
                F.struct("a", "b", "octave"), F.struct("n", "a", "b", "octave")
            ).alias("p")
        )
        .select("p.a", "p.b", "p.octave")
        .distinct()
    )
    best = written(join.screened(best, sketches))
    first = join.verified(best, texts)
    groups = components(first)
    rest = apart(pairs, groups).join(best, ["a", "b"], "left_anti")
    rest = written(join.screened(rest, sketches))
    second = join.verified(rest, texts)
    groups = components(linked(groups, second))
    release(spark)
    # First the likeliest pairs, which join most groups, then all that are left: they
    # are in the buckets where a node had more than one.
    more = written(residual(join, members, groups, sketches, True))
    release(spark)
    keys = more.where("more > 0").select("key").distinct()
    members = written(members.join(keys, "key", "left_semi"))
    more = more.select("a", "b").distinct()
    for done in (best, rest):
        more = more.join(done, ["a", "b"], "left_anti")
    third = join.verified(written(more), texts)
    groups = components(linked(groups, third))
    release(spark)
    left = written(residual(join, members, groups, sketches, False))
    release(spark)
    last = join.linked(left, texts)
    if last.count():
        groups = components(linked(groups, last))
    release(spark)
    return grouped(join.nodes, groups, "node")


def linked(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of the groups that ``links`` make of ``groups``."""
    held = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return held.unionByName(links.select("a", "b"))
