"""Language of a text by rank-order profiles of its letter n-grams.

A profile lists the most frequent n-grams of one to three letters, words
bounded by blanks. The out-of-place distance adds up how far each n-gram of a
text's profile stands from its place in the language's profile, and the most
for one that is missing there; the nearest language wins.

Letters are coded by their code points (Latin letters one by one, others by a
hash), n-grams by a hash of their letters, so a text's counts are one
``bincount``.

Defined results: a null text and one without letters is ``und`` with score 0,
and so are all texts if nothing could be learned; ties go to the language whose
name sorts first, ties of counts to the lower slot; repeated rows get equal
answers; other columns are ignored. The score is one minus the nearest
distance over the farthest possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sampled
from .words import chunks, mix

CODES = 64
SLOTS = 1 << 14
PROFILE = 400
SAMPLE_ROWS = 8000
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def letter_table() -> np.ndarray:
    """Code of every code point; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            latin = low - 96 if 97 <= low <= 122 else 27 + low % (CODES - 27)
            table[point] = latin
    return table


def slots(texts: list[str], table: np.ndarray):
    """``(doc, slot)`` of all n-grams, and whether a text has letters."""
    raw = " ".join(texts) + " "
    points = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
    codes = table[points]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    # Runs of what is no letter are told once.
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    codes, doc = codes[keep].astype(np.uint64), doc[keep]
    one = codes
    two = codes[:-1] * np.uint64(CODES) + codes[1:]
    three = two[:-1] * np.uint64(CODES) + codes[2:]
    found = [
        (doc[one > 0], one[one > 0]),
        # Not over the end of a text, nor of two blanks.
        (doc[1:], two + np.uint64(CODES**2)),
        (doc[2:], three + np.uint64(CODES**3)),
    ]
    same = [
        np.ones(int((one > 0).sum()), bool),
        doc[1:] == doc[:-1],
        (doc[2:] == doc[:-2]) & (codes[1:-1] > 0),
    ]
    docs = np.concatenate([d[s] for (d, _), s in zip(found, same)])
    grams = np.concatenate([g[s] for (_, g), s in zip(found, same)])
    has = np.bincount(found[0][0], minlength=len(texts)) > 0
    return docs, (mix(grams) % np.uint64(SLOTS)).astype(np.int64), has


def ranked(counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent slots, most frequent first."""
    size = min(size, int((counts > 0).sum()))
    # Counts first, lower slots before higher ones among equals.
    keys = counts.astype(np.int64) * SLOTS + np.arange(SLOTS - 1, -1, -1)
    top = np.argpartition(keys, -size)[-size:] if size else np.zeros(0, np.int64)
    return top[np.argsort(-keys[top])]


def counted(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of the n-grams of one language's share of rows."""
    table, total = letter_table(), np.zeros(SLOTS, np.int64)
    texts = [t or "" for t in rows["text"]]
    for first, last in chunks(texts):
        total += np.bincount(slots(texts[first:last], table)[1], minlength=SLOTS)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [total.tobytes()]})


def profiles(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Profile of each language, from at most ``rows`` rows that have one."""
    known = docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull())
    chosen = sampled(known.select("doc_id"), "doc_id", rows).distinct()
    parts = (
        known.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
        .groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
        .applyInPandas(counted, "lang string, counts binary")
        .collect()  # at most eight rows for each language of the sample
    )
    found: dict[str, np.ndarray] = {}
    for part in parts:
        counts = np.frombuffer(part["counts"], np.int64)
        found[part["lang"]] = found.get(part["lang"], 0) + counts
    return {lang: ranked(counts) for lang, counts in sorted(found.items())}


def places(profile: np.ndarray) -> np.ndarray:
    """Rank of each slot; ``PROFILE`` for one that is missing."""
    place = np.full(SLOTS, PROFILE, np.int32)
    place[profile] = np.arange(len(profile))
    return place


def predictor(model):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = letter_table()
        names = list(model.value)
        where = np.array([places(p) for p in model.value.values()])
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            langs, scores = [], []
            for first, last in chunks(texts):
                doc, slot, has = slots(texts[first:last], table)
                order = np.argsort(doc, kind="stable")
                slot = slot[order]
                edges = np.searchsorted(doc[order], np.arange(last - first + 1))
                for k in range(last - first):
                    if not has[k] or not names:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    own = ranked(
                        np.bincount(slot[edges[k] : edges[k + 1]], minlength=SLOTS)
                    )
                    far = np.abs(where[:, own] - np.arange(len(own))).sum(axis=1)
                    best = int(far.argmin())
                    langs.append(names[best])
                    scores.append(1 - float(far[best]) / (PROFILE * len(own)))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "lang_pred": langs,
                    "score": scores,
                }
            )

    return predict


def language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(profiles(docs, rows))
    held = (fold("doc_id", 4) == 2).alias("held_out")
    rows_ = docs.select("doc_id", "text", held)
    return rows_.mapInPandas(predictor(model), RESULT)
