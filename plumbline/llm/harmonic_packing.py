"""Harmonic packing of token sequences.

A length above ``capacity / (k + 1)`` and at most ``capacity / k`` belongs to
class ``k``, and a bin of class ``k`` takes exactly ``k`` pieces. Documents are
cut so that nearly all pieces have lengths that fill their bins to the brim:
whole sequences, then halves, quarters and so on down to ``smallest``, and one
short tail. Every task fills bins of its own, so nothing is shuffled and a lost
task is packed again alone; at its end a task puts the pieces of the bins that
did not fill up together, longest first.

Defined results: a null or empty text is the end mark alone, one piece of one
token; repeated rows are packed as often as they occur; other columns are
ignored; an empty table gives no piece. Sequence ids number the tasks in the
upper bits and the sequences of a task in the lower 32.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import tidy

CAPACITY = 1024
SMALLEST = 16
END = 0
CACHE = 1_000_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)

# Fixed value: how this vocabulary splits a text before pairs are merged.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def blanks_meet(text: str) -> bool:
    """Whether a blank of ``text`` has white space beside it."""
    if "  " in text:
        return True
    return any(c in text and (f"{c} " in text or f" {c}" in text) for c in WHITE)


def letters_only(text: str) -> bool:
    """Whether ``text`` is letters, and all of scripts on which no version differs."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


class Encoder:
    """Token ids of a text as little-endian 32-bit numbers.

    A blank between two other characters always starts a piece, so the parts
    between such blanks are encoded one by one and remembered.

    With ``added`` the vocabulary's added tokens are one id each where a text
    holds them, as a tokenizer does by itself, and text like any other without
    (its ``encode_special_tokens``).
    """

    def __init__(self, vocabulary: str, added: bool = False):
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self._letters = {b: 256 + k for k, b in enumerate(rest)}
        self._whole = Tokenizer.from_str(vocabulary)
        self._tokenize = self._whole.model.tokenize
        size = self._whole.get_vocab_size()
        self._bytes = [k.to_bytes(4, "little") for k in range(size)]
        tokens = (json.loads(vocabulary).get("added_tokens") or []) if added else []
        self._added = {t["content"]: t["id"].to_bytes(4, "little") for t in tokens}
        # The longest of those that begin at one place.
        names = map(re.escape, sorted(self._added, key=len, reverse=True))
        self._apart = re.compile(f"({'|'.join(names)})") if tokens else None
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        self._plain = not any(t.get(f) for t in tokens for f in flags)
        self._pieces = regex.compile(PIECES).findall
        self._blank = chr(self._letters[32])
        self._spelt: dict[str, str] = {}
        self._known: dict[str, bytes] = {}
        self._after: dict[str, bytes] = {}  # of a blank and the key

    def _spell(self, char: str) -> str:
        found = char.encode("utf-8").decode("latin-1").translate(self._letters)
        if len(self._spelt) < 4096:
            self._spelt[char] = found
        return found

    def _one(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # its bytes are its letters
            letters = piece.replace(" ", self._blank)
        else:
            spelt = self._spelt
            letters = "".join([spelt.get(c) or self._spell(c) for c in piece])
        return b"".join([self._bytes[t.id] for t in self._tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        ids = self._known.get(piece)
        if ids is None:
            ids = self._known[piece] = self._one(piece)
        return ids

    def _part(self, part: str) -> bytes:
        """Of a blank and ``part``."""
        after = self._after
        ids = after.get(part)
        if ids is None:
            body, last = part[:-1], part[-1:]
            if letters_only(part):  # one piece
                ids = self._one(" " + part)
            elif last in (",", ".") and letters_only(body):  # two
                ids = self._part(body) + self._piece(last)
            else:
                first, *rest = self._pieces(" " + part)
                whole = letters_only(first[1:])
                ids = self._part(first[1:]) if whole else self._piece(first)
                ids += b"".join(map(self._piece, rest))
            after[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self._apart or not self._apart.search(text):
            return self._text(text)
        if not self._plain:  # more than the token itself decides
            ids = self._whole.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        found = self._apart.split(text)
        found[0::2] = map(self._text, found[0::2])
        found[1::2] = map(self._added.get, found[1::2])
        return b"".join(found)

    def _text(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self._known) + len(self._after) > CACHE:
            self._known.clear()
            self._after.clear()
        if blanks_meet(text):
            return b"".join(map(self._piece, self._pieces(text)))
        head, *tail = text.split(" ")
        ids = list(map(self._after.get, tail))
        at = 0
        for _ in range(ids.count(None)):
            at = ids.index(None, at)
            ids[at] = self._part(tail[at])
        return b"".join([*map(self._piece, self._pieces(head)), *ids])


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order."""
    found = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            found.append(size)
            rest -= size
        size //= 2
    return [*found, rest] if rest else found


class Bins:
    """Open bins of one task, one for each class."""

    def __init__(self, task: int, capacity: int):
        self._next = task << 32
        self._capacity = capacity
        self._open: dict[int, list[tuple]] = {}

    def _close(self, rows: list[tuple]) -> list[tuple]:
        number, offset, done = self._next, 0, []
        self._next += 1
        for row in rows:
            done.append((*row, number, offset))
            offset += row[2]
        return done

    def put(self, row: tuple) -> list[tuple]:
        """The rows of the bin that ``row`` fills up, if any."""
        room = self._capacity // row[2]
        held = self._open.setdefault(room, [])
        held.append(row)
        if len(held) < room:
            return []
        del self._open[room]
        return self._close(held)

    def rest(self) -> list[tuple]:
        rows = [row for held in self._open.values() for row in held]
        self._open.clear()
        done, held, used = [], [], 0
        for row in sorted(rows, key=lambda row: -row[2]):
            if used + row[2] > self._capacity:
                done += self._close(held)
                held, used = [], 0
            held.append(row)
            used += row[2]
        return done + self._close(held) if held else done


def packer(vocabulary, capacity: int, smallest: int, added: bool):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        from pyspark import TaskContext

        encoder = Encoder(vocabulary.value, added)
        bins = Bins(TaskContext.get().partitionId(), capacity)
        end = END.to_bytes(4, "little")
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text or "") + end
                doc = None if pd.isna(doc) else int(doc)
                n, start = len(ids) // 4, 0
                for length in cut(n, capacity, smallest):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows += bins.put((doc, start, length, crc, n))
                    start += length
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(bins.rest(), columns=names)

    return pack


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: int = CAPACITY,
    smallest: int = SMALLEST,
    added: bool = False,
) -> DataFrame:
    """A row for each piece: where it was cut from and where it is put.

    With ``added`` the ids are those of a tokenizer left at its defaults, which
    takes the vocabulary's added tokens out of the texts.

    The vocabulary file is read here and sent to the executors; its size does
    not depend on the data.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.select("doc_id", "text").mapInPandas(
        tidy(packer(vocabulary, capacity, smallest, added)), SCHEMA
    )
