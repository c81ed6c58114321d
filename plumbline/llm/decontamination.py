"""Benchmark decontamination by a positional inverted index.

Every window of a benchmark item is looked up by its rarest term. The index
holds a posting for each place in the corpus where such a term stands, with
the words around it, so that the lists of the window's other terms, shifted by
their offsets, are intersected in the posting itself, rarest first.

Only DataFrame and SQL functions run, and no text is shuffled: the corpus is
read twice, once to count terms and once to index them.

Defined results: a null or empty text has no words and no hits; an item
without words is no test; a repeated row (same id, same text) counts once; a
window that occurs often counts each word once. Columns of ``docs`` other than
the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ASCII digits and letters, and all that is not ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
WINDOW = 13
BROADCAST_ROWS = 100_000
MASK_BITS = 1 << 20


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def small(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(word, UPPER, UPPER.lower())


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id, terms``: all windows, or the whole of a shorter item."""
    words = items.select(
        "item_id", F.transform(raw_words(F.col("text")), small).alias("words")
    ).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)))
    return starts.select(
        "item_id", F.slice("words", F.col("col") + 1, size).alias("terms")
    ).distinct()


def checked(side: DataFrame, rows: int) -> DataFrame:
    """A side to join with: broadcast only if it is known to be small."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each of ``terms`` stands in the corpus."""
    n = terms.count()
    found = docs.select(F.explode(raw_words(F.col("text"))).alias("w"))
    return (
        found.select(F.lower("w").alias("term"))
        .join(checked(terms, n), "term")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )


def with_anchors(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with ``order``: offsets from the rarest term to the commonest.

    A window with a term that the corpus lacks cannot occur and goes.
    """
    key = ["item_id", "terms"]
    places = tests.select(*key, F.posexplode("terms").alias("offset", "w"))
    known = places.withColumn("term", F.lower("w")).join(counts, "term")
    return (
        known.groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("n", "offset"))).alias("ranked"))
        .where(F.size("ranked") == F.size("terms"))
        .select(*key, F.col("ranked.offset").alias("order"))
        .withColumn("at", F.col("order")[0])
        .withColumn("anchor", F.lower(F.col("terms")[F.col("at")]))
    )


def mask(anchors: DataFrame, rows: int) -> list[int]:
    """A bit for every slot that an anchor's hash falls into, in 64-bit words."""
    bits = min(MASK_BITS, max(1 << 12, 1 << (16 * max(rows, 1)).bit_length()))
    slot = F.pmod(F.xxhash64("anchor"), F.lit(bits))
    cells = (
        anchors.select(slot.alias("slot"))
        .distinct()
        .groupBy(F.expr("cast(slot div 64 as int)").alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set"))
    )
    found = [0] * (bits // 64)
    for row in cells.collect():  # at most MASK_BITS / 64 rows
        found[row["cell"]] = row["set"]
    return found


def postings(docs: DataFrame, cells: list[int], reach: int) -> DataFrame:
    """``doc_id, copy, n_words, pos, anchor, around``, one row per place.

    ``around`` holds the words from ``reach`` before the place to ``reach``
    after it, and ``from`` the place of its first one. A document without a
    place keeps one row in which they are null.
    """
    bits = len(cells) * 64
    held = F.lit(cells).cast("array<bigint>")

    def marked(word: Column) -> Column:
        slot = F.pmod(F.xxhash64(F.lower(word)), F.lit(bits))
        cell = F.get(held, F.shiftright(slot, 6).cast("int"))
        return F.getbit(cell, slot.bitwiseAND(63).cast("int")) == 1

    words = docs.select(
        "doc_id",
        F.xxhash64("text").alias("copy"),
        raw_words(F.col("text")).alias("words"),
    )
    place = F.transform("words", lambda w, i: F.when(marked(w), i))
    place = F.filter(place, lambda i: i.isNotNull())
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.transform(
        place,
        lambda i: F.struct(
            i.alias("pos"),
            F.slice(
                "words",
                F.greatest(i - reach, F.lit(0)) + 1,
                F.lit(2 * reach + 1),
            ).alias("around"),
        ),
    )
    each = words.select(
        "doc_id",
        "copy",
        F.size("words").cast("long").alias("n_words"),
        F.explode_outer(near).alias("near"),
    )
    return each.select(
        "doc_id", "copy", "n_words", F.col("near.pos"), F.col("near.around")
    ).select(
        "doc_id",
        "copy",
        "n_words",
        "pos",
        F.transform("around", small).alias("around"),
        first.alias("from"),
        F.lower(F.get("around", F.col("pos") - first)).alias("anchor"),
    )


def phrase_hits(found: DataFrame, tests: DataFrame, rows: int) -> DataFrame:
    """Postings with the windows that stand there word for word.

    Adds ``item_id, start, length``, null where no window does.
    """
    # An item may be without id, so matches are told by a column of their own.
    tests = tests.withColumn("matched", F.lit(True))
    joined = found.join(checked(tests, rows), "anchor", "left")
    start = F.col("pos") - F.col("at")
    # The other terms, rarest first: the check ends at the first that differs.
    same = F.forall(
        "order",
        lambda o: F.coalesce(
            F.try_element_at("around", (start - F.col("from") + o + 1).cast("int"))
            == F.get("terms", o),
            F.lit(False),
        ),
    )
    hit = F.col("matched").isNotNull() & (start >= 0) & same
    return joined.select(
        "doc_id",
        "copy",
        "n_words",
        F.when(hit, F.col("item_id")).alias("item_id"),
        F.when(hit, start).alias("start"),
        F.when(hit, F.size("terms")).alias("length"),
    )


def proximity_hits(
    found: DataFrame, tests: DataFrame, rows: int, within: int
) -> DataFrame:
    """``doc_id, item_id``: all terms of a window stand near its rarest one.

    In any order, at most ``within`` words from it; ``found`` must reach so far.
    """
    joined = found.join(checked(tests, rows), "anchor")
    at = F.col("pos") - F.col("from")
    first = F.greatest(at - within, F.lit(0))
    near = F.slice("around", first + 1, at - first + within + 1)
    return (
        joined.where(F.size(F.array_except("terms", near)) == 0)
        .select("doc_id", "item_id")
        .distinct()
    )


def covered(spans: Column) -> Column:
    """How many places the sorted ``(start, length)`` spans cover."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (
                a["n"]
                + F.greatest(
                    s["start"] + s["length"] - F.greatest(a["end"], s["start"]),
                    F.lit(0),
                )
            ).alias("n"),
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )


def index(docs: DataFrame, items: DataFrame, size: int = WINDOW, reach: int = 0):
    """``(postings, tests, rows)`` for the phrases of ``items`` in ``docs``."""
    tests = windows(items, size)
    terms = tests.select(F.explode("terms").alias("w")).select(
        F.lower("w").alias("term")
    )
    tests = with_anchors(tests, term_counts(docs, terms.distinct())).persist()
    rows = tests.count()
    cells = mask(tests, rows)
    return postings(docs, cells, max(size - 1, reach)), tests, rows


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20
) -> DataFrame:
    """Per document its words, the hit ones and the items they come from.

    ``contaminated``: at least one word in ``share`` is hit.
    """
    return verdicts(docs, items, size, share).drop("copy")


def verdicts(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20
) -> DataFrame:
    """``contamination`` with ``copy``, the ``xxhash64`` of the judged text."""
    docs = docs.select("doc_id", "text")
    items = items.select("item_id", "text")
    found, tests, rows = index(docs, items, size)
    hits = phrase_hits(found, tests, rows)
    span = F.struct("start", "length")
    out = hits.groupBy("doc_id", "copy").agg(
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), span)).alias("spans"),
        F.collect_set(F.col("item_id").cast("string")).alias("items"),
        # Items without id are one more item, without a name.
        F.max(
            (F.col("start").isNotNull() & F.col("item_id").isNull()).cast("long")
        ).alias("nameless"),
    )
    hit = covered(F.array_sort("spans"))
    return out.select(
        "doc_id",
        "copy",
        "n_words",
        hit.alias("n_hit"),
        (F.size("items") + F.col("nameless")).cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )
