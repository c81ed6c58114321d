"""Hashes of all words of many texts at once, in numpy.

Texts are laid end to end as UTF-8. A word is a run of bytes that are no
separators; its hash is polynomial modulo 2**64, read off one running sum, and
then mixed, so that no Python code runs for a word.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20


def byte_table(chosen) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


# space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = byte_table([32, 9, 10, 11, 12, 13])
LOWER = lower_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


class Hasher:
    """Word hashes; keeps the powers between calls."""

    def __init__(self):
        self._up = powers(BASE, 1024)
        self._down = powers(INVERSE, 1024)

    def _reach(self, n: int) -> None:
        if n > len(self._up):
            self._up = powers(BASE, n)
            self._down = powers(INVERSE, n)

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Hash of ``values[s:e]`` for every ``s, e``; values are small ints."""
        n = len(values) + 1
        self._reach(n)
        total = np.zeros(n, np.uint64)
        np.cumsum(
            (values.astype(np.uint64) + np.uint64(1)) * self._up[: n - 1],
            out=total[1:],
        )
        return mix((total[ends] - total[starts]) * self._down[starts])

    def words(self, texts: list[str], separators=BLANKS, lower: bool = True):
        """``(doc, hash, start, end, raw)``: an entry for each word, in order.

        ``doc`` numbers the texts from zero; ``start`` and ``end`` are places in
        ``raw``, all the bytes as they were.
        """
        raw = b" ".join(t.encode("utf-8", "replace") for t in texts) + b" "
        raw = np.frombuffer(raw, np.uint8)
        values = LOWER[raw] if lower else raw
        apart = separators[values]
        edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        if not apart[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        limits = np.cumsum(
            np.fromiter(
                (len(t.encode("utf-8", "replace")) + 1 for t in texts),
                np.int64,
                len(texts),
            )
        )
        doc = np.searchsorted(limits, starts, side="right")
        return doc, self.runs(values, starts, ends), starts, ends, raw


def chunks(texts: list[str], size: int = CHUNK):
    """``(first, last)`` places of runs of texts of some ``size`` characters."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shape_table() -> np.ndarray:
    """Capital, letter or digit; other ASCII bytes stand for themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[48:58] = 1, 2, 3
    table[128:] = 2
    return table


SHAPES = shape_table()


def shape_hashes(hasher: Hasher, raw, starts, ends) -> np.ndarray:
    """Hashes of the words' shapes: kinds of characters, runs told once."""
    kinds = SHAPES[raw]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    place = np.cumsum(keep)
    return hasher.runs(kinds[keep], place[starts] - 1, place[ends - 1])
