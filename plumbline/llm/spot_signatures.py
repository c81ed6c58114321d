"""Document fingerprints from spot signatures.

A spot is an anchor with the chain of the next ``CHAIN`` content words after it.
Anchors are a few very common words, and of all other words, which are the
content words, those whose hash is a multiple of ``EVERY``: whether a word is an
anchor depends on the word alone, so near copies have near sets whatever their
sizes, and texts of languages without common words here have spots too. The set
of a text's spots is its fingerprint; two fingerprints are as alike as their
sets are by Jaccard's measure.

Defined results: a text without a spot has one, all of its words; a
text without words, a null or empty one too, has the fingerprint ``-``, alike
to itself only. The document after the last is the first; a single document
follows itself; null ids come first; rows with equal ids are ordered by their
texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Hasher, byte_table, chunks, mix

CHAIN = 2
EVERY = 4
EMPTY = "-"
SLICE_ROWS = 2048
SLICES = 20_000
LENGTH = 11
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)

# Common words of a few languages.
ANCHORS = (
    "the of and to in a is that it for was on are as with be by this not or an "
    "der die das und den von zu mit sich des auf nicht ein eine im dem ist es "
    "le la les de du des et en un une que est pour dans qui par sur pas au il "
    "el los las y se del con no una por su para al lo como o"
).split()

# All ASCII but digits and letters parts words.
APART = byte_table(
    b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)
)


def anchor_hashes(hasher: Hasher) -> np.ndarray:
    return np.sort(np.unique(hasher.words([" ".join(ANCHORS)], APART)[1]))


def spots(hasher: Hasher, anchors: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    """Each text's spots as sorted, distinct 64-bit hashes."""
    doc, word, *_ = hasher.words(texts, APART)
    place = np.minimum(np.searchsorted(anchors, word), len(anchors) - 1)
    common = anchors[place] == word
    content = np.flatnonzero(~common)
    # Where the chain after each word begins among the content words.
    at = np.arange(len(word))
    first = np.cumsum(~common)
    whole = first + CHAIN <= len(content)
    at, first = at[whole], first[whole]
    whole = doc[content[first + CHAIN - 1]] == doc[at]
    at, first = at[whole], first[whole]
    spot = word[at]
    for k in range(CHAIN):
        spot = mix(spot * np.uint64(31) + word[content[first + k]])
    anchored = common[at] | (word[at] % np.uint64(EVERY) == 0)
    at, spot = at[anchored], spot[anchored]
    edges = np.searchsorted(doc[at], np.arange(len(texts) + 1))
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    found = []
    for k in range(len(texts)):
        chosen = np.unique(spot[edges[k] : edges[k + 1]])
        if not len(chosen) and ends[k] < ends[k + 1]:
            words = word[ends[k] : ends[k + 1]]
            chosen = hasher.runs(words.view(np.uint8), [0], [len(words) * 8])
        found.append(chosen)
    return found


def encoded(spots: np.ndarray) -> str:
    """The set as text: a few letters for each spot, in order."""
    return ",".join(np.base_repr(int(s), 36)[:LENGTH].lower() for s in spots) or EMPTY


def decoded(fingerprint: str) -> set[str]:
    return set(fingerprint.split(","))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard's measure of two spot sets; 0 where it stays below ``least``.

    Texts without words are alike to each other only.
    """
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    found = common / (small + large - common)
    return found if found >= least else 0.0


def bounds(docs: DataFrame, rows: int) -> tuple[int, list[int]]:
    """How often an id is null, and ids that part the table into slices.

    Slices hold some ``rows`` documents, more where there would be over
    ``SLICES`` of them, so that the list of bounds stays short.
    """
    n_rows, n_ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    n = min(n_ids // rows + 1, SLICES)
    if n == 1:
        return n_rows - n_ids, []
    shares = [k / n for k in range(1, n)]
    at = F.percentile_approx("doc_id", shares, 20 * n)
    return n_rows - n_ids, sorted(set(docs.select(at).first()[0]))


def in_order(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """``slice, doc_id, text, copied``: each slice sorted, then the next's first.

    A bound is an id of the table, so it is known which documents are first in
    their slices; those are sent to two slices. The texts are shuffled once.
    """
    nulls, starts = bounds(docs, rows or SLICE_ROWS)
    first = None if nulls else docs.agg(F.min("doc_id")).first()[0]
    n = len(starts) + 1

    @F.pandas_udf("int")
    def own(ids: pd.Series) -> pd.Series:
        known = ids.to_numpy(float, na_value=-np.inf)
        exact = ids.fillna(0).to_numpy(np.int64)
        found = np.searchsorted(np.array(starts, np.int64), exact, side="right")
        return pd.Series(np.where(np.isinf(known), 0, found))

    number = own(F.col("doc_id")) if starts else F.lit(0)
    leads = F.col("doc_id").eqNullSafe(F.lit(first))
    if starts:
        leads = leads | F.coalesce(F.col("doc_id").isin(starts), F.lit(False))
    before = F.pmod(F.col("number") - 1, F.lit(n))
    put = F.array(F.struct(F.col("number").alias("slice"), F.lit(False).alias("copied")))
    twice = F.concat(
        put, F.array(F.struct(before.alias("slice"), F.lit(True).alias("copied")))
    )
    placed = docs.withColumn("number", number).select(
        "doc_id", "text", F.explode(F.when(leads, twice).otherwise(put)).alias("put")
    )
    return (
        placed.select("put.slice", "doc_id", "text", "put.copied")
        .repartition(n, "slice")
        .sortWithinPartitions(
            "slice", "copied", F.col("doc_id").asc_nulls_first(), "text"
        )
    )


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprinter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    hasher = Hasher()
    anchors = anchor_hashes(hasher)
    held: list = []  # the row that waits for the one after it

    def judged(rows: list) -> pd.DataFrame:
        """``rows``: documents in order, each with the one that follows."""
        out = []
        own_texts = [r[1] for r in rows]
        changed = [edited(r[1], r[2]) for r in rows]
        for first, last in chunks(own_texts):
            part = own_texts[first:last]
            own = spots(hasher, anchors, [*part, rows[last - 1][2]])
            new = spots(hasher, anchors, changed[first:last])
            for k, (doc, text, _) in enumerate(rows[first:last]):
                out.append(
                    (
                        doc,
                        len(text),
                        hashlib.sha256(
                            changed[first + k].encode("utf-8", "replace")
                        ).hexdigest(),
                        encoded(own[k]),
                        encoded(new[k]),
                        likeness(own[k], new[k]),
                        likeness(own[k], own[k + 1]),
                    )
                )
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    for batch in batches:
        rows = []
        for number, doc, text, copied in zip(
            batch["slice"], batch["doc_id"], batch["text"], batch["copied"]
        ):
            doc = None if pd.isna(doc) else int(doc)
            text = text or ""
            if held and held[0][0] == number:
                rows.append((held[0][1], held[0][2], text))
            held = [] if copied else [(number, doc, text)]
        yield judged(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, with likenesses."""
    docs = docs.select("doc_id", "text")
    return in_order(docs).mapInPandas(fingerprinter, RESULT)
