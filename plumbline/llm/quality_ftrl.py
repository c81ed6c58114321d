"""Text quality by logistic regression on hashed word n-grams.

A text is two streams of words: the words themselves in lower case and their
shapes (``Aa.``, ``a,``, ``A!``). One to three neighbours make an n-gram, which
is hashed to one of ``2**BITS`` weights; its value is its share of the text, so
that a score is a sparse dot product and long texts weigh no more than short
ones. Follow-the-regularised-leader updates train the weights on
``SHARDS`` parts of a bounded sample of labelled rows at once, and the parts'
weights are averaged.

Defined results: a null or empty text has no n-gram, so its score is that of
the bias alone; without labelled rows all scores are 0.5; rows with a null
label are not learned from; repeated rows get equal scores; other columns are
ignored. Sources of labels other than ``labels`` and ids never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sampled, tidy
from .words import Hasher, chunks, mix, shape_hashes

BITS = 18
SHARDS = 4
SAMPLE_ROWS = 6000
EPOCHS = 4
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCORES = "doc_id long, held_out boolean, score double"


def families(hasher: Hasher, texts: list[str]):
    """``(doc, slots)`` of each family of n-grams."""
    doc, word, starts, ends, raw = hasher.words(texts)
    shape = shape_hashes(hasher, raw, starts, ends)
    joined = lambda a, b, salt: mix(a * np.uint64(31) + b + np.uint64(salt))
    pair = doc[1:] == doc[:-1]
    three = doc[2:] == doc[:-2]
    twice = joined(shape[:-1], shape[1:], 3)
    found = [
        (doc, mix(word + np.uint64(1))),
        (doc[1:][pair], joined(word[:-1], word[1:], 2)[pair]),
        (doc, mix(shape + np.uint64(5))),
        (doc[1:][pair], twice[pair]),
        (doc[2:][three], joined(twice[:-1], shape[2:], 4)[three]),
        # A word after itself, whichever it is.
        (
            doc[1:][pair],
            mix((word[1:] == word[:-1]).astype(np.uint64) + np.uint64(6))[pair],
        ),
    ]
    sizes = np.bincount(doc, minlength=len(texts))
    last = np.uint64(64 - BITS)
    return sizes, [(d, (h >> last).astype(np.int64)) for d, h in found]


class Leader:
    """Per-coordinate FTRL-proximal state for logistic loss."""

    def __init__(self, size: int):
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / step)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def vectors(texts: list[str]):
    """Each text's slots with their values; the last slot is the bias."""
    hasher = Hasher()
    for first, last in chunks(texts):
        part = texts[first:last]
        sizes, found = families(hasher, part)
        doc = np.concatenate([d for d, _ in found])
        slot = np.concatenate([s for _, s in found])
        order = np.argsort(doc, kind="stable")
        doc, slot = doc[order], slot[order]
        edges = np.searchsorted(doc, np.arange(len(part) + 1))
        for k in range(len(part)):
            at, count = np.unique(slot[edges[k] : edges[k + 1]], return_counts=True)
            value = count * (SCALE / max(1, sizes[k]))
            yield np.append(at, 1 << BITS), np.append(value, 1.0)


def train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    data = list(vectors([t or "" for t in rows["text"]]))
    labels = rows["label"].to_numpy(float)
    leader = Leader((1 << BITS) + 1)
    turns = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in turns.permutation(len(data)):
            leader.learn(*data[k], labels[k])
    weights = leader.weights().astype(np.float32)
    return pd.DataFrame({"rows": [len(rows)], "weights": [weights.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled rows outside fold 0."""
    marked = labels.where((fold("doc_id", 5) != 0) & F.col("label").isNotNull())
    marked = sampled(marked.select("doc_id", "label"), "doc_id", rows)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard")
    parts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(marked), "doc_id")  # at most ``rows`` ids
        .select(shard, "doc_id", "text", "label")
        .groupBy("shard")
        .applyInPandas(train, "rows long, weights binary")
        .collect()  # one row for each shard
    )
    total = sum(p["rows"] for p in parts)
    found = np.zeros((1 << BITS) + 1, np.float32)
    for p in parts:
        found += np.frombuffer(p["weights"], np.float32) * (p["rows"] / total)
    return found


# Characters whose n-grams are held at once while scoring; each takes some 100 bytes.
SCORED_AT_ONCE = 1 << 18


def scored(model_weights: np.ndarray, hasher: Hasher, texts: list[str]) -> np.ndarray:
    sums = np.zeros(len(texts))
    for first, last in chunks(texts, SCORED_AT_ONCE):
        sizes, found = families(hasher, texts[first:last])
        for doc, slot in found:
            sums[first:last] += np.bincount(
                doc, model_weights[slot], minlength=last - first
            ) * (SCALE / np.maximum(1, sizes))
    return 1 / (1 + np.exp(-np.clip(sums + model_weights[-1], -30, 30)))


def scorer(model):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, hasher = model.value, Hasher()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            scores = scored(weights, hasher, texts)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "score": scores,
                }
            )

    return score


def keeper(model, threshold: float):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, hasher = model.value, Hasher()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            yield batch[scored(weights, hasher, texts) >= threshold]

    return keep


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that reach ``threshold``, all columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInPandas(tidy(keeper(model, threshold)), docs.schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``; ``labels``: ``doc_id, label``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    scores = rows.mapInPandas(scorer(model), SCORES)
    good = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scores.select("doc_id", "held_out", "score", good)
