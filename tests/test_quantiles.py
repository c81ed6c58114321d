"""Exact quartiles against sorting, over awkward distributions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import iqr_outliers
from plumbline.plans.brackets import Brackets
from plumbline.plans.quantiles import approximate_quartiles
from plumbline.plans.table import Table

INF = float("inf")


def element(values, q):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    return known[max(1, math.ceil(q * len(known))) - 1] if known else None


def distributions():
    r = random.Random(7)
    n = 3000
    close = [1.0 + i * 2.0**-52 for i in range(n)]
    r.shuffle(close)
    return {
        "uniform": [r.random() for _ in range(n)],
        "normal": [r.gauss(0, 1) for _ in range(n)],
        "heavy": [math.exp(r.gauss(0, 40)) for _ in range(n)],
        "both_signs": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(n)],
        "adjacent_doubles": close,
        "tiny": [r.randrange(1, 50) * 5e-324 for _ in range(n)],
        "huge": [r.uniform(-1.79e308, 1.79e308) for _ in range(n)],
        "integers": [float(r.randrange(-5, 6)) for _ in range(n)],
        "epochs": [1.7e15 + r.randrange(10**9) for _ in range(n)],
        "hot_third": [42.0 if i % 3 == 0 else r.random() for i in range(n)],
        "hot_quarter": [0.0] * (n // 4) + [r.random() for _ in range(n - n // 4)],
        "constant": [3.5] * n,
        "infinite": [r.choice([-INF, INF, r.random()]) for _ in range(n)],
        "zeros": [r.choice([0.0, -0.0, 1e-320, -1e-320]) for _ in range(n)],
        "with_nan": [r.choice([float("nan"), None, r.random()]) for _ in range(n)],
        "nothing": [None] * n,
        "one": [None] * (n - 1) + [9.0],
        "two": [None] * (n - 2) + [9.0, 8.0],
    }


@pytest.fixture(scope="module")
def columns():
    return distributions()


@pytest.fixture(scope="module")
def wide(spark, columns):
    schema = ", ".join(f"{name} double" for name in columns)
    df = spark.createDataFrame(list(zip(*columns.values())), schema)
    return df.repartition(7)


def table(df):
    return Table(df, {"iqr_outliers": dict(iqr_outliers.OPTIONS)})


def exact_quartiles(t):
    b = Brackets(t, t.number_fields, 1.5)
    return b.quartiles(b.placed())


def test_exact_quartiles_are_elements(wide, columns):
    t = table(wide)
    found = {r["idx"]: (r["q1"], r["q3"]) for r in exact_quartiles(t).collect()}
    expected = {
        i: (element(v, 0.25), element(v, 0.75))
        for i, v in enumerate(columns.values())
        if element(v, 0.25) is not None
    }
    assert found == expected


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 11])
def test_small_counts(spark, n):
    # One query per count, every residue of n in its own column.
    values = [float(i * i) for i in range(1, n + 1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    t = table(df)
    (row,) = exact_quartiles(t).collect()
    assert (row["q1"], row["q3"]) == (element(values, 0.25), element(values, 0.75))


def test_approximate_quartiles_have_close_ranks(wide, columns):
    t = table(wide)
    rows = approximate_quartiles(t.numbers(t.number_fields)).collect()
    names = list(columns)
    assert {names[r["idx"]] for r in rows} == set(names) - {"nothing"}
    for name in ("uniform", "normal", "heavy", "adjacent_doubles"):
        (row,) = [r for r in rows if names[r["idx"]] == name]
        ordered = sorted(columns[name])
        for q, value in ((0.25, row["q1"]), (0.75, row["q3"])):
            assert abs(ordered.index(value) / len(ordered) - q) <= 0.011


def test_outlier_counts_by_brute_force(wide, columns):
    found = {r["column"]: r for r in iqr_outliers.metrics(wide).collect()}
    for name, values in columns.items():
        q1, q3 = element(values, 0.25), element(values, 0.75)
        spread = None if q1 is None else q3 - q1
        if not spread or not math.isfinite(spread):
            assert name not in found
            continue
        low, high = q1 - 1.5 * spread, q3 + 1.5 * spread
        outside = [
            v for v in values if v is not None and (math.isnan(v) or v < low or v > high)
        ]
        assert found[name]["outliers"] == len(outside), name


def test_a_quartile_outside_its_bracket_is_an_error(wide):
    """A sketch that errs more than it may fails the query; it gives no wrong number."""
    b = Brackets(table(wide), table(wide).number_fields, 1.5)
    b.ends = b.ends.withColumns({"high1": F.col("low1") - 1, "low3": F.col("high3") + 1})
    with pytest.raises(Exception, match="escaped its bracket"):
        b.outliers().collect()


def test_few_values_are_kept(spark):
    """Some two per cent of the values are counted one by one, whatever the table."""
    r = random.Random(5)
    rows = [(r.random(), r.gauss(0, 1), float(k % 7)) for k in range(40_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    b = Brackets(table(df), table(df).number_fields, 1.5)
    assert b.placed().count() < 0.04 * 2 * 40_000
    found = {r["idx"]: (r["q1"], r["q3"]) for r in exact_quartiles(table(df)).collect()}
    for k, values in enumerate(zip(*rows)):
        assert found[k] == (element(values, 0.25), element(values, 0.75))
