"""Leaving rows out of a shuffle must not change what is counted."""

import random
from collections import Counter, defaultdict

import pytest

from plumbline import lint
from plumbline.functions import positional
from plumbline.operators import case_variants, category_dominance, duplicate_rows
from plumbline.plans import duplicates, values


def texts(seed=3, n=6000):
    """A third of the rows hold one value, a third spellings of another."""
    r = random.Random(seed)
    base = "the quick brown fox jumps"

    def spelling():
        return "".join(r.choice([c, c.upper()]) for c in base)

    rows = []
    for i in range(n):
        kind = i % 3
        hot = "hot" if kind == 0 else spelling() if kind == 1 else f"text {i}"
        rows.append((hot, r.choice(["a", "A", "b", None]), f"unique {i}" * 5))
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "hot string, few string, free string").repartition(6)


def brute_variants(rows, i):
    groups = defaultdict(set)
    for row in rows:
        if row[i] is not None:
            groups[row[i].lower()].add(row[i])
    many = {k: v for k, v in groups.items() if len(v) > 1}
    counted = sum(1 for row in rows if row[i] is not None and row[i].lower() in many)
    return len(many), counted, sum(len(v) - 1 for v in many.values())


@pytest.mark.parametrize("slots", [None, 2, 64])
def test_variants_by_brute_force(df, rows, monkeypatch, slots):
    if slots is not None:  # so few slots that unrelated texts share them
        monkeypatch.setattr(values, "SLOTS", slots)
        monkeypatch.setattr(values, "SLOTS_PER_VALUE", 2)
    found = {r["column"]: tuple(r)[1:] for r in case_variants.metrics(df).collect()}
    expected = {n: brute_variants(rows, i) for i, n in enumerate(df.columns)}
    assert found == {n: v for n, v in expected.items() if v[0]}


@pytest.mark.parametrize("threshold", [0.9, 0.3, 0.2, 0.0001])
def test_dominance_by_brute_force(df, rows, threshold):
    found = {
        (r["column"], r["value"]): r["n"]
        for r in category_dominance.metrics(df, threshold=threshold).collect()
    }
    expected = {
        (name, value): n
        for i, name in enumerate(df.columns)
        for value, n in Counter(row[i] for row in rows).items()
        if n / len(rows) > threshold
    }
    assert found == expected


def test_both_together_as_apart(df):
    columns = ["code", "column", "occurrences", "sample"]
    chosen = ["category_dominance", "case_variants"]
    options = {"category_dominance": {"threshold": 0.3}}
    together = lint(df, chosen, options=options).select(*columns).collect()
    apart = [
        row
        for c in chosen
        for row in lint(df, [c], options={c: options.get(c, {})}).select(*columns).collect()
    ]
    assert together == apart


def test_different_column_options_do_not_mix(spark):
    df = spark.createDataFrame([("a",), ("A",), ("b",)], "s string")
    options = {"category_dominance": {"columns": ["s"]}}
    found = lint(df, ["category_dominance", "case_variants"], options=options).collect()
    assert [(r["status"], r["occurrences"]) for r in found] == [("OK", 0), ("LINT", 1)]


@pytest.mark.parametrize("slots", [None, 64, 128])
def test_duplicates_by_brute_force(spark, monkeypatch, slots):
    if slots is not None:
        monkeypatch.setattr(duplicates, "SLOTS", slots)
    r = random.Random(5)
    rows = [(1, "copy", None)] * 2000
    rows += [(r.randrange(300), r.choice("xy"), r.random() < 0.5) for _ in range(1000)]
    rows += [(i, "single", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c boolean").repartition(5)
    counted = [n for n in Counter(rows).values() if n > 1]
    row = duplicate_rows.metrics(df).first()
    assert tuple(row) == (len(counted), sum(n - 1 for n in counted))


def test_findings_do_not_depend_on_partitions(spark, df):
    numbers = df.selectExpr("*", "cast(length(hot) * 7 % 19 as double) - 3 as n")
    first = lint(numbers.coalesce(1)).collect()
    assert lint(numbers.repartition(9, "free").orderBy("few")).collect() == first


def test_doubling_a_table_of_distinct_rows(spark):
    df = spark.range(500).selectExpr("id", "cast(id as string) as s")
    assert duplicate_rows.metrics(df.union(df)).first()["surplus"] == 500


def passed(df):
    """Rows that the filter of a grouping of duplicates lets through."""
    rows, fields = positional(df)
    return duplicates.candidates(rows, fields).count()


def test_few_other_rows_pass_with_many_repeated_ones(spark):
    singles = spark.range(0, 400_000).selectExpr("id", "id * 7 as b")
    df = singles.union(singles.where("id % 100 = 0"))
    assert passed(df) <= 2 * 8_000
    assert duplicate_rows.metrics(df).first()["surplus"] == 4_000


def test_few_values_pass_a_low_threshold(spark):
    assert values.slots_for(0.0005) >= 8 / 0.0005
    assert values.slots_for(0.9) < 64


@pytest.mark.parametrize("threshold", [0.9, 0.3, 0.02, 0.004, 0.0005])
@pytest.mark.parametrize("also", [[], ["case_variants"]])
def test_frequent_values_by_brute_force(spark, threshold, also):
    """Shares on both sides of the threshold, among many values that occur once."""
    r = random.Random(11)
    n = 4000
    columns = []
    for share in (threshold * 1.01, threshold * 0.99, threshold / 2):
        k = round(n * share) + (1 if share > threshold else 0)
        values_ = [f"Hot {len(columns)}"] * k + [f"once {i}" for i in range(n - k)]
        r.shuffle(values_)
        columns.append(values_)
    nulls = [None if i < n * threshold + 1 else f"v{i % 1500}" for i in range(n)]
    columns.append(nulls)
    columns.append([i % 50 < 49 for i in range(n)])
    df = spark.createDataFrame(
        list(zip(*columns)), "a string, b string, c string, d string, e boolean"
    ).repartition(16)
    found = lint(
        df,
        ["category_dominance", *also],
        options={"category_dominance": {"threshold": threshold}},
        samples=False,
    ).where("code = 'DL003' and status = 'LINT'")
    got = Counter((x["column"], x["sample"][0], x["occurrences"]) for x in found.collect())
    expected = Counter()
    for name, values_ in zip("abcde", columns):
        for value, count in Counter(values_).items():
            if count / n > threshold:
                text = None if value is None else str(value)
                expected[name, text.lower() if isinstance(value, bool) else text, count] += 1
    assert got == expected


def test_frequent_values_shuffle_summaries_only(df):
    """No hash of a text is shuffled to find out that none is frequent."""
    plan = category_dominance.metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k" in plan.lower() or "approxtopk" in plan.lower()
    assert plan.count("Aggregate [idx") == 1
