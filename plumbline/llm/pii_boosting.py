"""Personal data by candidate generation and gradient-boosted trees.

Four kinds are looked for: email, ip, card and phone. Fixed patterns give the
base spans, which always stay. Wider generators then propose overlapping
candidates (``name at host dot org``, phones without a plus sign, cards with
odd separators, addresses in brackets); boosted trees of its kind judge each by
its format and its context, and a threshold per kind, calibrated on candidates
held out from training, selects which of them are added.

All candidates of all texts are learned from. A tree reads a feature only as the
step of a fixed scale that it falls on, so equal candidates are counted as one
cell; of the cells each level of each round of trees asks one sum of gradients
by node, feature and step. Up to ``CELLS`` cells are summed at once, more by
Spark from a written table. Sums are of whole numbers, so the trees depend
neither on that nor on how the table is partitioned.

The trees learn from the corpus itself: a candidate that is a base span is
right, and one that has the form but fails the test of its kind (Luhn's sum,
parts up to 255, number of digits) or is a mere number or word is wrong. The
outcome of a test is no feature, so that forms without a test can be judged.

Defined results: a null or empty text has no span; overlapping added spans of
a kind keep the highest score, then the leftmost, then the longest; spans never
overlap a base span of their kind; repeated rows get equal spans; other columns
are kept by ``redacted`` and ignored by ``spans``. Without any base span in the
table nothing is added.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DEPTH, RATE = 12, 3, 0.4
PRECISION = 0.995
# Gradients are summed, and margins told apart, as multiples of these parts.
UNIT, STEP = 1 << 20, 100
MARGINS = 1 << 14
CELLS = 1 << 15
RESULT = (
    "doc_id long, text string, kinds array<string>, starts array<int>, "
    "ends array<int>, base array<boolean>"
)

# The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A match takes a run of digits to its end, so none begins within one. Without the
# mark in front, a long run would be read anew from each of its digits.
IP_PLACE = re.compile(f"(?<![0-9]){IP.pattern}")
WIDE = {
    "email": re.compile(
        r"[\w.%+-]+(?:\s?(?:@|\(at\)|\[at\])\s?|\sat\s)[\w-]+"
        r"(?:\.[\w-]+|\s?(?:\(dot\)|\[dot\])\s?[\w-]+|\sdot\s[\w-]+)+"
    ),
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]+){1,3}"),
    "card": re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9]){11,22}"),
    "phone": re.compile(r"(?:\+|\b00|\()?[0-9](?:[\x20()./-]{0,3}[0-9]){5,16}"),
}
# What may come before the sign in a wide email: a whole run, and only before a sign.
NAMES = re.compile(
    r"(?<![\w.%+-])[\w.%+-]+(?=\s?(?:@|\(at\)|\[at\])|\sat\s)"
)


class Covered:
    """Spans that may overlap, asked for any that overlaps another."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        n = int(digit)
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, looked for around each ``@`` only."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def passes(kind: str, value: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in value.split(".")]
        return all(len(p) < 4 and int(p) <= 255 for p in parts)
    digits = only_digits(value)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind and place."""
    found = [("email", s, e) for s, e in emails(text)]
    if re.search("[0-9]", text):
        for kind, pattern in (("ip", IP_PLACE), ("card", CARD), ("phone", PHONE)):
            found += [
                (kind, m.start(), m.end())
                for m in pattern.finditer(text)
                if passes(kind, m.group())
            ]
    return found


def wide_emails(text: str) -> Iterator[tuple[int, int]]:
    """The wide pattern's matches, looked for at the names before a sign only."""
    end = 0
    for name in NAMES.finditer(text):
        start = max(name.start(), end)
        match = WIDE["email"].match(text, start) if start < name.end() else None
        if match:
            end = match.end()
            yield start, end


def candidates(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in wide_emails(text)]
    if re.search("[0-9]", text):
        for kind in ("ip", "card", "phone"):
            found += [(kind, m.start(), m.end()) for m in WIDE[kind].finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its neighbours; not the test of its kind."""
    value = text[start:end]
    digits = only_digits(value)
    groups = re.findall("[0-9]+", value)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    words = re.findall(r"\w+", before.lower())
    marks = re.sub(r"[\w\s]", "", value)
    return [
        KINDS.index(kind),
        len(value),
        len(digits),
        len(digits) / len(value),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        value.count("."),
        value.count("@"),
        value.count("-"),
        value.count(" "),
        len(set(marks)),
        value.startswith("+"),
        "(" in value,
        value[-1].isdigit(),
        sum(c.isupper() for c in value),
        before[-1:].isalnum(),
        before[-1:].isspace() or not before,
        before[-1:] in "=:\"'",
        after[:1].isalnum(),
        after[:1] in ".-%/",
        bool(words) and words[-1] in ("version", "v", "no", "nr", "id", "page"),
        bool(words)
        and words[-1] in ("mail", "email", "tel", "phone", "fax", "call", "ip", "card"),
        bool(re.search(r"\s(at|dot)\s", value)),
    ]


# -- trees -----------------------------------------------------------------

COUNTS = (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 9.5, 11.5, 14.5, 17.5, 20.5, 24.5, 31.5)
LENGTHS = (6.5, 7.5, 8.5, 9.5, 10.5, 11.5, 12.5, 13.5, 14.5, 15.5, 17.5, 19.5, 22.5, 26.5, 31.5)
PARTS = (0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)
# The scale of each feature, in their order.
SCALES = [COUNTS, LENGTHS, LENGTHS, PARTS, *[COUNTS] * 8, *[(0.5,)] * 3, COUNTS, *[(0.5,)] * 8]
STEPS = 16


def binned(x: np.ndarray) -> np.ndarray:
    """The step of its scale that each feature of each row falls on."""
    steps = [np.searchsorted(scale, column) for scale, column in zip(SCALES, x.T)]
    return np.stack(steps, 1).astype(np.uint8)


class Trees:
    """Boosted regression trees for logistic loss, of every kind its own.

    A tree is three arrays: feature and threshold (a step) of each inner node in
    the order of a heap, and the value of each leaf. A round has a tree for each
    kind, and its arrays one row for each.
    """

    def __init__(self, start: np.ndarray):
        self.start = start
        self.rounds: list = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.of(binned(x))

    def of(self, steps: np.ndarray) -> np.ndarray:
        kind = steps[:, 0]
        total = self.start[kind]
        for feature, threshold, leaf in self.rounds:
            at = nodes(steps, feature, threshold, DEPTH)
            total = total + leaf[kind, at - (2**DEPTH - 1)]
        return total


def nodes(steps: np.ndarray, feature, threshold, depth: int) -> np.ndarray:
    """The node at ``depth`` of its kind's tree that each row comes to."""
    rows, kind = np.arange(len(steps)), steps[:, 0]
    node = np.zeros(len(steps), np.int64)
    for _ in range(depth):
        right = steps[rows, feature[kind, node]] > threshold[kind, node]
        node = 2 * node + 1 + right
    return node


def matrix(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(-1, len(SCALES))


def summed(trees: Trees, feature, threshold, level: int):
    """Sums of gradients by kind, node of a level, feature and step."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(KINDS) * 2**level * len(SCALES) * STEPS
        g_sum, h_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            steps = matrix(batch["cell"])
            p = 1 / (1 + np.exp(-trees.of(steps)))
            n = batch["n"].to_numpy()
            g = np.rint((batch["label"].to_numpy() - p) * UNIT).astype(np.int64) * n
            h = np.rint(p * (1 - p) * UNIT).astype(np.int64) * n
            node = nodes(steps, feature, threshold, level) - (2**level - 1)
            first = (steps[:, 0] * 2**level + node)[:, None] * len(SCALES)
            slot = (first + np.arange(len(SCALES))) * STEPS + steps
            np.add.at(g_sum, slot, g[:, None])
            np.add.at(h_sum, slot, h[:, None])
        some = np.flatnonzero((g_sum != 0) | (h_sum != 0))
        yield pd.DataFrame({"slot": some, "g": g_sum[some], "h": h_sum[some]})

    return add


def applied(cells: DataFrame | pd.DataFrame, function, by: list[str], sums: list[str]):
    """Sums by ``by`` of what ``function`` makes of the cells, whose rows are bounded."""
    if isinstance(cells, pd.DataFrame):
        return pd.concat(function(iter([cells]))).groupby(by, as_index=False)[sums].sum()
    schema = ", ".join(f"{c} long" for c in [*by, *sums])
    made = cells.mapInPandas(tidy(function), schema).groupBy(by)
    return made.agg(*(F.sum(c).alias(c) for c in sums)).toPandas()


def grown(cells: DataFrame | pd.DataFrame, trees: Trees) -> None:
    """Add a round: a tree for each kind, level by level."""
    inner = 2**DEPTH - 1
    feature = np.zeros((len(KINDS), inner), np.int64)
    threshold = np.full((len(KINDS), inner), STEPS)
    leaf = np.zeros((len(KINDS), 2**DEPTH))
    for level in range(DEPTH):
        # At most a row for each kind, node, feature and step.
        gradients = summed(trees, feature, threshold, level)
        sums = applied(cells, gradients, ["slot"], ["g", "h"])
        shape = (len(KINDS), 2**level, len(SCALES), STEPS)
        slot = sums["slot"].to_numpy(np.int64)
        g, h = np.zeros(np.prod(shape)), np.zeros(np.prod(shape))
        g[slot], h[slot] = sums["g"] / UNIT, sums["h"] / UNIT
        g, h = g.reshape(shape), h.reshape(shape)
        left_g, left_h = g.cumsum(-1), h.cumsum(-1)
        right_g, right_h = left_g[..., -1:] - left_g, left_h[..., -1:] - left_h
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
        gain -= left_g[..., -1:] ** 2 / (left_h[..., -1:] + 1)
        for kind in range(len(KINDS)):
            for k in range(2**level):
                f, t = np.unravel_index(gain[kind, k].argmax(), shape[2:])
                if gain[kind, k, f, t] <= 1e-6:
                    f, t = 0, STEPS - 1
                node = 2**level - 1 + k
                feature[kind, node], threshold[kind, node] = f, t
                if level == DEPTH - 1:
                    both = zip(
                        (left_g[kind, k, f, t], right_g[kind, k, f, t]),
                        (left_h[kind, k, f, t], right_h[kind, k, f, t]),
                    )
                    leaf[kind, 2 * k : 2 * k + 2] = [RATE * a / (b + 1) for a, b in both]
    trees.rounds.append((feature, threshold, leaf))


def judged(text: str):
    """``(value, features, label)`` of the candidates that can be told right or wrong."""
    right = set(base_spans(text))
    any_kind = Covered((s, e) for _, s, e in right)
    other = {k: Covered((s, e) for k2, s, e in right if k2 != k) for k in KINDS}
    for kind, start, end in dict.fromkeys([*candidates(text), *right]):
        value = text[start:end]
        if (kind, start, end) in right:
            label = 1
        elif other[kind].meets(start, end):
            label = 0
        elif any_kind.meets(start, end):
            continue
        else:
            strict = {"ip": IP, "card": CARD, "phone": PHONE, "email": EMAIL}[kind]
            wrong = kind in ("ip", "card") and not passes_loosely(kind, value)
            if not wrong and not strict.fullmatch(value) and not value.isdigit():
                continue
            label = 0
        yield value, features(text, kind, start, end), label


def passes_loosely(kind: str, value: str) -> bool:
    digits = only_digits(value)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    parts = re.findall("[0-9]+", value)
    return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)


def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``held, label, cell, n``: how often candidates fall on the same steps."""
    for batch in batches:
        rows, held, labels = [], [], []
        for text in batch["text"]:
            for value, found, label in judged(text or ""):
                rows.append(found)
                labels.append(label)
                # Equal values are held out together.
                held.append(zlib.crc32(value.encode("utf-8", "replace")) % 4 == 3)
        cells = [s.tobytes() for s in binned(np.array(rows, float))] if rows else []
        counts = Counter(zip(held, labels, cells))
        yield pd.DataFrame(
            [(*cell, n) for cell, n in counts.items()],
            columns=["held", "label", "cell", "n"],
        )


class Model:
    def __init__(self, trees: Trees, thresholds: dict[str, float]):
        self.trees = trees
        self.thresholds = thresholds


def floored(margin: np.ndarray) -> np.ndarray:
    """Margins as whole numbers of ``1 / STEP``, of which there are few."""
    most = MARGINS / 4
    return np.floor(np.clip(margin * STEP, -most, most)).astype(np.int64)


def calibrated(margin: np.ndarray, right: np.ndarray, n: np.ndarray) -> float:
    """The lowest margin from which ``PRECISION`` of the candidates are right."""
    order = np.argsort(-margin)
    share = np.cumsum(right[order]) / np.cumsum(n[order])
    good = np.flatnonzero(share >= PRECISION)
    return float(margin[order][good[-1]]) if len(good) else np.inf


def judge(trees: Trees):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = matrix(batch["cell"])
            n = batch["n"].to_numpy()
            rows = {"kind": steps[:, 0].astype(np.int64), "margin": floored(trees.of(steps))}
            yield pd.DataFrame(rows | {"good": batch["label"].to_numpy() * n, "n": n})

    return found


def fit(docs: DataFrame) -> Model | None:
    """Trees and thresholds from the candidates in all texts."""
    cells = written(
        docs.select("text")
        .mapInPandas(tidy(examples), "held boolean, label int, cell binary, n long")
        .groupBy("held", "label", "cell")
        .agg(F.sum("n").alias("n"))
    )
    kind = F.conv(F.hex(F.substring("cell", 1, 1)), 16, 10).cast("int")
    shares = (
        cells.groupBy("held", kind.alias("kind"), "label").agg(F.sum("n").alias("n")).collect()
    )  # at most a row for each kind, label and half
    count = {(r["held"], r["kind"], r["label"]): r["n"] for r in shares}
    if not any(label for _, _, label in count):
        return None
    learned, held = cells.where("not held"), cells.where("held")
    if len(cells.select("n").take(CELLS + 1)) <= CELLS:
        learned, held = learned.toPandas(), held.toPandas()
    ones, zeros = (
        np.array([count.get((False, k, y), 0) for k in range(len(KINDS))]) for y in (1, 0)
    )
    mean = np.clip((ones + 0.5) / (ones + zeros + 1), 1e-3, 1 - 1e-3)
    trees = Trees(np.log(mean / (1 - mean)))
    for _ in range(ROUNDS):
        grown(learned, trees)
    # At most ``MARGINS`` rows for each kind.
    margins = applied(held, judge(trees), ["kind", "margin"], ["good", "n"])
    thresholds = {}
    for k, name in enumerate(KINDS):
        own = margins[margins["kind"] == k]
        enough = count.get((True, k, 1), 0) >= 5
        columns = (own[c].to_numpy() for c in ("margin", "good", "n"))
        thresholds[name] = calibrated(*columns) if enough else np.inf
    return Model(trees, thresholds)


def added_spans(text: str, base: list, model: Model | None) -> list:
    if model is None:
        return []
    covered = Covered((s, e) for _, s, e in base)
    free = [(k, s, e) for k, s, e in candidates(text) if not covered.meets(s, e)]
    if not free:
        return []
    margin = model.trees.margin(np.array([features(text, *c) for c in free], float))
    taken: list[tuple[int, int, str]] = []
    for m, kind, s, e in sorted(
        ((m, *c) for m, c in zip(margin, free)), key=lambda c: (-c[0], c[2], -c[3])
    ):
        # Those taken do not overlap, so only the last that starts before the end can.
        before = bisect_left(taken, (e,))
        met = before > 0 and taken[before - 1][1] > s
        if floored(m) >= model.thresholds[kind] and not met:
            insort(taken, (s, e, kind))
    return [(kind, s, e) for s, e, kind in taken]


def finder(model):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in ("kinds", "starts", "ends", "base")}
            for text in batch["text"]:
                base = base_spans(text or "")
                spans = [(*s, True) for s in base]
                spans += [(*s, False) for s in added_spans(text or "", base, model.value)]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                for k, name in enumerate(columns):
                    columns[name].append([s[k] for s in spans])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"]} | columns)

    return find


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the spans, as arrays in order of kind and place."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.select("doc_id", "text").mapInPandas(finder(model), RESULT)


def redactor(model):
    def redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for text in batch["text"]:
                if text is None:
                    done.append(None)
                    continue
                base = base_spans(text)
                found = [*base, *added_spans(text, base, model.value)]
                parts, at = [], 0
                for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
                    if end <= at:
                        continue
                    # Overlapping spans are covered by one mark.
                    if start >= at:
                        parts += [text[at:start], f"<{kind}>"]
                    at = end
                done.append("".join([*parts, text[at:]]))
            yield batch.assign(text=done)

    return redact


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by the name of its kind."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.mapInPandas(tidy(redactor(model)), docs.schema)
