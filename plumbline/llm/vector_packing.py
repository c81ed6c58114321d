"""Best-fit packing under several capacities at once.

A sequence has room for so many tokens, so many documents and so much attention
(the sum of the squared lengths of its pieces, what attention within documents
costs). Pieces are placed longest first, each in the open sequence that fits it
best among those with room in every respect: by ``norm``, the one whose weighted
residual is smallest with the piece in it; by ``dot``, the one whose residual has
the smallest weighted product with what the piece takes up.

Texts are encoded where they are read, and only the pieces' lengths and checksums
go on. They are dealt into groups of some ``GROUP`` pieces that are packed
independently, so that memory is bounded and a lost task is packed again alone.

Defined results: a null or empty text is the end mark alone, one piece of one
token; repeated rows are packed as often as they occur; a null id is an id like any
other; other columns are ignored; an empty table gives no piece. Sequence ids have
the group in the upper bits and the sequence of the group in the lower 32.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

END = 1
GROUP = 8192
# Words that are remembered with their ids, and the longest of them.
CACHE, LONGEST = 600_000, 64
ROW = "id long, nameless boolean"
PIECE = "piece int, start long, length long, ids_crc32 long, doc_tokens long"
PIECES = f"{ROW}, {PIECE}"
PLACED = f"{PIECES}, sequence_id long, offset long"


class Capacity(NamedTuple):
    """What a sequence holds at most. Full attention is the square of the tokens."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits an empty sequence."""
        if self.documents < 1 or self.attention < 1 or self.tokens < 1:
            raise ValueError(f"no piece fits {self}")
        return min(self.tokens, int(self.attention**0.5))


# Letters whose lower case, normal form and class are the same for Python and the
# tokenizer: ASCII and the accented letters up to U+017F, but for the dotted capital I.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = "[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*"
# Fixed value: where this vocabulary parts a word, for such letters.
PARTS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+"


class Words(dict):
    """Ids of the words met so far, as little-endian 32-bit numbers.

    The vocabulary drops white space and nothing is merged across it, so the parts
    of a text between blanks are encoded by themselves. A plain word is parted here
    and only what is new of it goes to the tokenizer's model; any other goes to the
    tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        import re

        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(vocabulary)
        self._encode = whole.encode
        self._merge = whole.model.tokenize
        self._bytes = [k.to_bytes(4, "little") for k in range(whole.get_vocab_size())]
        # The vocabulary is written in one letter for each byte.
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        self._letters = {b: 256 + k for k, b in enumerate(others)}
        # Added tokens are one id wherever they stand.
        added = whole.get_added_tokens_decoder().values()
        without = "|".join(re.escape(token.content) for token in added) or "(?!)"
        self._plain = re.compile(f"(?!.*(?:{without})){PLAIN}").fullmatch
        self._parts = re.compile(PARTS).findall
        # Python takes these four for blanks, the vocabulary does not.
        self._odd = re.compile("[\x1c-\x1f]").search
        self._blanks = re.compile("[^\\S\x1c-\x1f]+").split

    def __missing__(self, word: str) -> bytes:
        if self._plain(word):
            ids = b"".join([self._part(part) for part in self._parts(word.lower())])
        else:
            found = self._encode(word, add_special_tokens=False).ids
            ids = b"".join([self._bytes[k] for k in found])
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """A part is a word of its own as well, with the same ids."""
        ids = self.get(part)
        if ids is None:
            spelt = part
            if not part.isascii():
                spelt = part.encode().decode("latin-1").translate(self._letters)
            ids = b"".join([self._bytes[t.id] for t in self._merge(spelt)])
            if len(part) <= LONGEST:
                self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        words = self._blanks(text) if self._odd(text) else text.split()
        return b"".join(map(self.__getitem__, words))


def encoder(vocabulary, longest: int, end: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        words = Words(vocabulary.value)
        mark = end.to_bytes(4, "little")
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for *row, text in zip(batch["id"], batch["nameless"], batch["text"]):
                ids = words.ids(text or "") + mark
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, longest)):
                    own = ids[4 * start : 4 * (start + longest)]
                    rows.append((*row, piece, start, len(own) // 4, zlib.crc32(own), n))
            yield pd.DataFrame(rows, columns=names)

    return pieces


def best_fit(
    lengths: np.ndarray, capacity: Capacity, weights: tuple, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of pieces that come longest first.

    ``tokens``, ``documents`` and ``attention`` are the residuals of the open
    sequences; one that no further piece fits leaves the search.
    """
    lengths = np.asarray(lengths, np.int64)
    tokens, documents, attention = (
        np.empty(len(lengths), np.int64) for _ in capacity
    )
    number = np.empty(len(lengths), np.int64)
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    least = int(lengths[-1]) if len(lengths) else 0
    opened = used = 0
    for k, length in enumerate(lengths.tolist()):
        square = length * length
        fits = np.flatnonzero(
            (tokens[:opened] >= length)
            & (documents[:opened] >= 1)
            & (attention[:opened] >= square)
        )
        if len(fits) == 0:
            at = opened
            tokens[at], documents[at], attention[at] = capacity
            number[at] = used
            opened, used = opened + 1, used + 1
        else:
            takes = (length, 1, square)
            score = 0.0
            for room, one, most, weight in zip(
                (tokens, documents, attention), takes, capacity, weights
            ):
                if rule == "norm":
                    score = score + weight * ((room[fits] - one) / most) ** 2
                else:
                    score = score + weight * (room[fits] / most) * (one / most)
            at = fits[np.argmin(score)]
        sequence[k] = number[at]
        offset[k] = capacity.tokens - tokens[at]
        tokens[at] -= length
        documents[at] -= 1
        attention[at] -= square
        if tokens[at] < least or documents[at] < 1 or attention[at] < least * least:
            opened -= 1
            for values in (tokens, documents, attention, number):
                values[at] = values[opened]
    return sequence, offset


def placer(capacity: Capacity, weights: tuple, rule: str):
    def place(pieces: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "nameless", "id", "start", "ids_crc32"]
        pieces = pieces.sort_values(order, ascending=[False, True, True, True, True])
        lengths = pieces["length"].to_numpy(np.int64)
        sequence, offset = best_fit(lengths, capacity, weights, rule)
        group = pieces["group"].to_numpy(np.int64)
        return pieces.drop(columns="group").assign(
            sequence_id=(group << 32) + sequence, offset=offset
        )

    return place


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: Capacity = Capacity(),
    weights: tuple = (1.0, 0.05, 0.05),
    rule: str = "norm",
    end: int = END,
) -> DataFrame:
    """A row for each piece: where it was cut from and where it is put.

    Documents longer than a sequence are cut into full pieces and a rest; no other
    is cut. ``rule`` is ``norm`` or ``dot``; ``weights`` are those of tokens,
    documents and attention in it.

    The vocabulary file is read here and sent to the executors; its size does not
    depend on the data. The number of groups follows the number of pieces.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule: {rule}")
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    nameless = F.col("doc_id").isNull()
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        nameless.alias("nameless"),
        "text",
    )
    pieces = written(
        texts.mapInPandas(encoder(vocabulary, capacity.longest, end), PIECES)
    )
    # Dealt by place, not by id, so that no id or length makes a large group.
    groups = max(1, round(pieces.count() / GROUP))
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = pieces.withColumn("group", F.pmod(place, F.lit(groups)))
    placed = dealt.groupBy("group").applyInPandas(
        placer(capacity, weights, rule), PLACED
    )
    names = [c.split()[0] for c in PLACED.split(", ")][2:]
    return placed.select(
        F.when(~F.col("nameless"), F.col("id")).alias("doc_id"), *names
    )
