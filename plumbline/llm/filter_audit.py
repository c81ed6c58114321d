"""What each filter of a chain removes, in every order that the chain can have.

A document's failures are one bit a filter, so a table is no more than some cells,
one for each part and mask, with the documents they hold. Each cell folds across
the array of all orders: ``aggregate`` walks an order with the cell still there or
gone, ``transform`` does so for all orders, and the structs it makes, one for each
order and step, are weighted by the cell's documents. The cells of a part are
merged by elementwise sums. The table is passed over once for the masks; all the
rest works on at most ``2 ** filters`` cells a part, whatever the table holds.

The filters of ``text_failures``: A under 100 words, B too few distinct words,
C too many capitals, D a symbol, E a copy of the text of a smaller id.

Defined results: a null text is empty, a null language the part ``""``; a row
without id has no label and is no copy, nor are others copies of it; rows of one id
and text are copies only of smaller ids; labels that repeat an id are taken
together, null labels are none; other columns are ignored; an empty table gives no
row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = "#$%&*|"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, filters: str = FILTERS) -> Column:
    """The failures that the text alone decides (A to D), as bits of a mask."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]"))
        > CAPITAL_PERCENT * F.char_length(whole),
        "D": whole.rlike(f"[{SYMBOLS}]"),
    }
    return sum(
        (F.when(fails[name], bit(filters, name)).otherwise(0) for name in fails if name in filters),
        F.lit(0),
    )


def bit(filters: str, name: str) -> int:
    return 1 << filters.index(name)


def judged(docs: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``doc_id, part, mask, n``: documents by what they fail, E included.

    Equal rows are one with a count. Whether a text is a copy is told by joining
    each text's hash and smallest id with the rows' own, so that a text which
    makes up a third of the table is no hot key.
    """
    rows = written(
        docs.select(
            "doc_id",
            F.coalesce("lang", F.lit("")).alias("part"),
            text_failures(F.col("text"), filters).alias("mask"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"),
        )
        .groupBy("doc_id", "part", "mask", "hash")
        .agg(F.count("*").alias("n"))
    )
    known = rows.where("doc_id is not null")
    first = known.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    copy = F.when(F.col("first").isNull(), bit(filters, "E")).otherwise(0)
    known = known.join(
        first.withColumn("first", F.lit(True)), ["hash", "doc_id"], "left"
    ).withColumn("mask", F.col("mask") + copy)
    names = ["doc_id", "part", "mask", "n"]
    return known.select(names).unionByName(
        rows.where("doc_id is null").select(names)
    )


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic`` of ``doc_id, part, mask, n``."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    nameless = rows.where("doc_id is null").withColumns(
        {"good": F.lit(False), "toxic": F.lit(False)}
    )
    found = named.unionByName(nameless)

    def of(mark: str) -> Column:
        return F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(mark)

    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def folded(orders: list[str], filters: str) -> Column:
    """An array of a struct for each order and step, of one cell."""
    fields = ", ".join(f"{name}: bigint" for name in COUNTS)
    steps = f"array<struct<filter: int, {fields}>>"
    walk = f"""
      aggregate(
        order,
        named_struct('there', 1L, 'steps', cast(array() as {steps})),
        (walk, f) -> named_struct(
          'there', walk.there * (1 - (shiftright(mask, f) & 1)),
          'steps', concat(walk.steps, array(named_struct(
            'filter', f,
            'kept', n * walk.there * (1 - (shiftright(mask, f) & 1)),
            'removed', n * walk.there * (shiftright(mask, f) & 1),
            'redundant', n * (1 - walk.there) * (shiftright(mask, f) & 1),
            'unique_fails', if(mask = shiftleft(1, f), n, 0L),
            'good_lost', good * walk.there * (shiftright(mask, f) & 1),
            'toxic_lost', toxic * walk.there * (shiftright(mask, f) & 1))))),
        walk -> walk.steps)"""
    listed = ", ".join(
        f"array({', '.join(str(filters.index(name)) for name in order)})"
        for order in orders
    )
    return F.expr(f"flatten(transform(array({listed}), order -> {walk}))")


def merged(arrays: str) -> Column:
    """Elementwise sums over ``arrays``, equally long arrays of structs."""
    sums = ", ".join(f"'{name}', x.{name} + y.{name}" for name in COUNTS)
    return F.expr(
        f"aggregate(slice({arrays}, 2, size({arrays})), {arrays}[0], (total, own) -> "
        f"zip_with(total, own, (x, y) -> named_struct('filter', x.filter, {sums})))"
    )


def order_audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the cells.

    ``part, filter_order, step`` and the counts; ``shapley`` is what the step's
    filter removes, summed over all orders.
    """
    orders = ["".join(order) for order in permutations(filters)]
    places = F.array(*(F.lit(order) for order in orders))
    shapley = F.expr(
        f"aggregate(steps, array_repeat(0L, {len(filters)}), (total, s) -> "
        "transform(total, (x, i) -> x + if(i = s.filter, s.removed, 0L)))"
    )
    return (
        counted.select("part", folded(orders, filters).alias("steps"))
        .groupBy("part")
        .agg(F.collect_list("steps").alias("each"))
        .select("part", merged("each").alias("steps"))
        .select("part", "steps", shapley.alias("shares"))
        .select("part", "shares", F.posexplode("steps").alias("at", "s"))
        .select(
            "part",
            F.get(places, F.expr(f"cast(at div {len(filters)} as int)")).alias("filter_order"),
            (F.col("at") % len(filters) + 1).alias("step"),
            *(F.col(f"s.{name}").alias(name) for name in COUNTS),
            F.get("shares", F.col("s.filter")).alias("shapley"),
        )
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters, for each language and order."""
    return order_audit(cells(judged(docs), labels))
