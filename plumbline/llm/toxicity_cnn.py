"""Toxicity by a convolutional text classifier, trained in numpy.

A word is embedded as the sum of hashed vectors: of the word itself and of its
first letters, so that inflected forms share a part. Filters over one, two and
three neighbouring words are rectified and pooled by their maximum over the
whole text, and a logistic layer reads the pooled values. The network is
trained on all labelled rows by Adam, with gradients that flow through the
pooled places only: in each of some rounds shards of some ``SHARD`` rows go on
from the same network, each by itself, and what they change is averaged, for a
row of the embedding table over the shards that changed it. Every round takes all
toxic rows and its share of the others, each of which is in one round.

Thresholds are calibrated on a fifth of the labelled rows, held out from training,
by language, where a language is a group of texts told by their commonest words
(never by a column); a score is shifted so that its language's threshold lies at
0.5.

Defined results: a null or empty text has no word and gets the score of the
biases alone; without labelled rows of both kinds to train on all scores are 0;
null labels are not learned from; repeated rows get equal scores; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAY, among, fold, release, tidy, written
from .words import Hasher, byte_table, mix

BITS = 16
WIDTH = 16
FILTERS = {1: 32, 2: 16, 3: 16}
PREFIXES = (3, 4, 5, 6, 7)
SHARD = 16_000
ROUNDS = 4
STEPS = 100  # of a shard in a round, at least
BATCH = 16
# Changes are averaged, and margins told apart, as multiples of these parts.
UNIT, STEP, MOST = 1 << 20, 100, 3000
RATE = 0.01
WORDS_AT_ONCE = 1 << 16
SCORES = "doc_id long, held_out boolean, score double"

APART = byte_table(
    b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)
)

# A few of the commonest words of some languages.
COMMON = {
    "en": "the of and to in is that it was for",
    "de": "der die und den von zu das nicht ist ein",
    "fr": "le la les et des du une que est dans",
    "es": "el los las y del que una por se con",
}
LANGUAGES = [*COMMON, "other"]


def slots(hasher: Hasher, texts: list[str]):
    """``(doc, word, ids)``: for each word its rows of the embedding table."""
    doc, word, starts, ends, raw = hasher.words(texts, APART)
    low = np.where((raw >= 65) & (raw < 91), raw + 32, raw).astype(np.uint8)
    parts = [mix(word + np.uint64(1))]
    for n in PREFIXES:
        parts.append(mix(hasher.runs(low, starts, np.minimum(starts + n, ends)) + np.uint64(n)))
    ids = np.stack(parts, 1) >> np.uint64(64 - BITS)
    return doc, word, ids.astype(np.int32)


def common_words(hasher: Hasher) -> list[np.ndarray]:
    return [np.sort(hasher.words([w], APART)[1]) for w in COMMON.values()]


def told(doc, word, common, n: int) -> np.ndarray:
    """Number of each text's language in ``LANGUAGES``, by its common words."""
    hits = np.stack(
        [np.bincount(doc[np.isin(word, c)], minlength=n) for c in common], 1
    )
    return np.where(hits.max(1) > 0, hits.argmax(1), len(common))


class Network:
    """Embedding table, filters of each width and the layer on top."""

    def __init__(self, seed: int = 11):
        turns = np.random.default_rng(seed)
        self.p = {
            "table": turns.normal(0, 0.1, (1 << BITS, WIDTH)),
            "out": turns.normal(0, 0.1, sum(FILTERS.values())),
            "bias": np.zeros(1),
        }
        for w, n in FILTERS.items():
            self.p[f"f{w}"] = turns.normal(0, (2 / (w * WIDTH)) ** 0.5, (w * WIDTH, n))
            self.p[f"b{w}"] = np.zeros(n)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def rows(self) -> np.ndarray:
        """All parameters in rows of ``WIDTH``, the embedding table first."""
        rest = np.concatenate([self.p[k].ravel() for k in sorted(self.p) if k != "table"])
        rest = np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)
        return np.concatenate([self.p["table"], rest])

    def put(self, rows: np.ndarray) -> None:
        rows = np.array(rows, np.float32)
        self.p["table"], rest, at = rows[: 1 << BITS], rows[1 << BITS :].ravel(), 0
        for name in sorted(self.p):
            if name != "table":
                size = self.p[name].size
                self.p[name] = rest[at : at + size].reshape(self.p[name].shape).copy()
                at += size

    def pooled(self, ids: np.ndarray):
        """Maxima of all filters over the words of one text, and their places."""
        x = self.p["table"][ids].sum(1)
        tops, places = [], []
        for w, n in FILTERS.items():
            if len(x) < w:
                tops.append(np.zeros(n, np.float32))
                places.append(np.full(n, -1))
                continue
            wide = x if w == 1 else np.hstack([x[k : len(x) - w + 1 + k] for k in range(w)])
            values = wide @ self.p[f"f{w}"] + self.p[f"b{w}"]
            at = values.argmax(0)
            top = values[at, np.arange(n)]
            tops.append(np.maximum(top, 0))
            places.append(np.where(top > 0, at, -1))
        return x, np.concatenate(tops), places

    def margins(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Margins of ``n`` texts whose words lie end to end."""
        out = np.zeros((n, sum(FILTERS.values())), np.float32)
        for first in range(0, len(doc), WORDS_AT_ONCE):
            # Two words more, so that no neighbours are parted.
            part = slice(first, min(first + WORDS_AT_ONCE + 2, len(doc)))
            x = self.p["table"][ids[part, 0]]
            for k in range(1, ids.shape[1]):
                x = x + self.p["table"][ids[part, k]]
            d, at = doc[part], 0
            for w, m in FILTERS.items():
                last = len(x) - w + 1
                if last > 0:
                    f = self.p[f"f{w}"]
                    values = x[:last] @ f[:WIDTH]
                    for k in range(1, w):
                        values += x[k : last + k] @ f[k * WIDTH : (k + 1) * WIDTH]
                    values += self.p[f"b{w}"]
                    whole = d[:last] == d[w - 1 :]
                    own, values = d[:last][whole], values[whole]
                    if len(own):
                        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        tops = np.maximum.reduceat(values, heads, axis=0)
                        out[own[heads], at : at + m] = np.maximum(
                            out[own[heads], at : at + m], tops
                        )
                at += m
        return out @ self.p["out"] + self.p["bias"][0]


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, name: str, g: np.ndarray, at=slice(None)) -> None:
        m = self.m[name][at] * 0.9 + 0.1 * g
        v = self.v[name][at] * 0.99 + 0.01 * g * g
        self.m[name][at], self.v[name][at] = m, v
        fix = (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        self.p[name][at] -= RATE * fix * m / (np.sqrt(v) + 1e-6)


def learn(net: Network, adam: Adam, batch: list, labels: np.ndarray) -> None:
    """One step on some texts; only the pooled words get a gradient."""
    grads = {k: np.zeros_like(v) for k, v in net.p.items() if k != "table"}
    rows, steps = [], []
    for ids, label in zip(batch, labels):
        x, top, places = net.pooled(ids)
        margin = float(top @ net.p["out"] + net.p["bias"][0])
        g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / len(batch)
        grads["out"] += g * top
        grads["bias"] += g
        back, at = g * net.p["out"], 0
        for (w, n), place in zip(FILTERS.items(), places):
            j = np.flatnonzero(place >= 0)
            words, d = place[j][:, None] + np.arange(w), back[at + j]
            wide = x[words].reshape(len(j), w * WIDTH)
            grads[f"f{w}"][:, j] += (d[:, None] * wide).T
            grads[f"b{w}"][j] += d
            rows.append(ids[words.ravel()])
            steps.append((d * net.p[f"f{w}"][:, j]).T.reshape(-1, WIDTH))
            at += n
    adam.t += 1
    for name, g in grads.items():
        adam.step(name, g)
    if rows and sum(map(len, rows)):
        wide = np.repeat(np.concatenate(steps), len(PREFIXES) + 1, axis=0)
        slot = np.concatenate(rows).ravel()
        order = np.argsort(slot, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
        total = np.add.reduceat(wide[order], heads, axis=0)
        adam.step("table", total, slot[order][heads])


def cut(margin: np.ndarray, label: np.ndarray, count=1) -> float:
    """The threshold with the fewest errors, midway between its neighbours."""
    m, at = np.unique(margin, return_inverse=True)
    toxic, clean = (np.bincount(at, np.where(label == y, count, 0)) for y in (1, 0))
    # Errors if all below an edge are called clean and the rest toxic.
    errors = np.append(0, np.cumsum(toxic)) + np.append(np.cumsum(clean[::-1])[::-1], 0)
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    return float(np.median(edges[best]))


CHANGES = f"slot long, {', '.join(f'c{k} long' for k in range(WIDTH))}"


def trainer(start, turn: int):
    """The parameters that a shard's rows change, and by how much."""

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label", "text"], kind="stable")
        texts, labels = rows["text"].tolist(), rows["label"].to_numpy(np.float32)
        hasher, net = Hasher(), Network()
        net.put(start.value)
        adam, before = Adam(net.p), net.rows()
        turns = np.random.default_rng(turn)
        for _ in range(-(-STEPS * BATCH // max(len(texts), STEPS * BATCH // 8))):
            order = turns.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                doc, _, ids = slots(hasher, [texts[i] or "" for i in at])
                edges = np.searchsorted(doc, np.arange(len(at) + 1))
                batch = [ids[edges[i] : edges[i + 1]] for i in range(len(at))]
                learn(net, adam, batch, labels[at])
        change = np.rint((net.rows() - before).astype(float) * UNIT).astype(np.int64)
        slot = np.flatnonzero(change.any(1))
        columns = {f"c{k}": change[slot, k] for k in range(WIDTH)}
        return pd.DataFrame({"slot": slot} | columns)

    return train


def margins(model):
    """``lang, label, margin``: margins as whole numbers of ``1 / STEP``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, net = Hasher(), Network()
        net.put(model.value)
        common = common_words(hasher)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for first, last in batches_of(texts):
                doc, word, ids = slots(hasher, texts[first:last])
                margin = np.rint(net.margins(doc, ids, last - first) * STEP)
                yield pd.DataFrame(
                    {
                        "lang": told(doc, word, common, last - first),
                        "label": batch["label"].to_numpy()[first:last],
                        "margin": np.clip(margin, -MOST, MOST).astype(np.int64),
                    }
                )

    return find


class Model:
    """A trained network with the thresholds of the languages."""

    def __init__(self, rows: np.ndarray, cuts: np.ndarray):
        self.net = Network()
        self.net.put(rows)
        self.cuts = cuts


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, from all labelled rows outside fold 0."""
    spark = docs.sparkSession
    marked = labels.where(fold("doc_id", 5) != 0).where("label is not null")
    marked = marked.select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    part = F.xxhash64(F.lit(7), "doc_id")
    # The same join for tables of any size: of texts, those of labelled rows are shuffled.
    hashed = F.xxhash64("doc_id")
    found = written(
        among(docs.select("doc_id", "text"), hashed, marked.select(hashed.alias("h")))
        .where(F.col(MAY))
        .drop(MAY)
        .join(marked.hint("merge"), "doc_id")
        .withColumn("held", F.pmod(part, F.lit(5)) == 4)
        .withColumn("turn", F.pmod(F.shiftright(part, 8), F.lit(ROUNDS)))
    )
    release(spark)
    learned = found.where("not held")
    count = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    if len(count) < 2:
        return None
    # Of all rows, not those of a round, so that shards are alike in every round.
    shards = -(-sum(count.values()) // SHARD)
    shard = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(shards))
    learned = learned.withColumn("shard", shard)
    now = Network().rows()
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(now)
        changes = (
            learned.where((F.col("label") > 0) | (F.col("turn") == turn))
            .groupBy("shard")
            .applyInPandas(trainer(start, turn), CHANGES)
            .groupBy("slot")
            .agg(*(F.avg(f"c{k}").alias(f"c{k}") for k in range(WIDTH)))
            .toPandas()  # at most a row for each of the network's
        )
        now = now.copy()
        now[changes["slot"].to_numpy()] += changes.drop(columns="slot").to_numpy() / UNIT
        release(spark)
    # At most a row for each language, label and one of the margins told apart.
    find = tidy(margins(spark.sparkContext.broadcast(now)))
    scores = (
        found.where("held")
        .select("text", "label")
        .mapInPandas(find, "lang int, label int, margin long")
        .groupBy("lang", "label", "margin")
        .count()
        .toPandas()
    )
    cuts = np.zeros(len(LANGUAGES))
    for k in range(len(LANGUAGES)):
        own = scores[scores["lang"] == k]
        seen = own.groupby("label")["count"].sum()
        use = own if (seen >= 5).sum() == 2 else scores
        if len(use):
            cuts[k] = cut(*(use[c].to_numpy() for c in ("margin", "label", "count"))) / STEP
    return Model(now, cuts)


def batches_of(texts: list[str], size: int = 1 << 19):
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= size or k + 1 == len(texts):
            yield first, k + 1
            first, held = k + 1, 0


def scorer(model):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        common = common_words(hasher)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            scores = np.zeros(len(texts))
            if model.value is not None:
                for first, last in batches_of(texts):
                    doc, word, ids = slots(hasher, texts[first:last])
                    margin = model.value.net.margins(doc, ids, last - first)
                    lang = told(doc, word, common, last - first)
                    margin = np.clip(margin - model.value.cuts[lang], -30, 30)
                    # Sums differ in their last bits with what else is in a batch.
                    scores[first:last] = np.round(1 / (1 + np.exp(-margin)), 5)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "score": scores,
                }
            )

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted``; ``labels``: ``doc_id, label``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    scores = rows.mapInPandas(scorer(model), SCORES)
    toxic = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scores.select("doc_id", "held_out", "score", toxic)
