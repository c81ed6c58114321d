"""One test per boundary of each check's definition."""

from decimal import Decimal

import pytest
from conftest import by_column, the_ok
from pyspark.sql import types as T

from plumbline import FINDING_SCHEMA, lint
from plumbline.operators import (
    BUILT_IN,
    case_variants,
    category_dominance,
    duplicate_rows,
    empty_columns,
    iqr_outliers,
    negative_values,
    numeric_text,
    unnamed_columns,
)

NAN, INF = float("nan"), float("inf")


def column(spark, values, kind, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")


# -- unnamed columns


def test_unnamed_by_substring_and_case(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "Unnamed: 0", "x Unnamed", "unnamed"])
    found = by_column(unnamed_columns.findings(df))
    assert set(found) == {"Unnamed: 0", "x Unnamed"}
    assert found["Unnamed: 0"]["occurrences"] == 1
    assert found["Unnamed: 0"]["sample"] == ["Unnamed: 0"]


def test_unnamed_generated_names_on_request(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["_c0", "_c12", "_c1x"])
    the_ok(unnamed_columns.findings(df))
    found = by_column(unnamed_columns.findings(df, match_generated=True))
    assert set(found) == {"_c0", "_c12"}


# -- empty columns


def test_empty_means_null_only(spark):
    rows = [(None, NAN, "", " ", None), (None, NAN, "", " ", 1)]
    df = spark.createDataFrame(rows, "a string, b double, c string, d string, e int")
    found = by_column(empty_columns.findings(df))
    assert set(found) == {"a"}
    assert found["a"]["occurrences"] == 2 and found["a"]["sample"] == [None]


def test_empty_dataset_is_ok_and_says_so(spark):
    df = spark.createDataFrame([], "a string, b int")
    for check in (empty_columns, category_dominance):
        assert the_ok(check.findings(df))["message"] == empty_columns.EMPTY_DATASET
    for check in BUILT_IN:
        the_ok(check.findings(df))


def test_no_columns(spark):
    df = spark.createDataFrame([], T.StructType([]))
    for check in BUILT_IN:
        the_ok(check.findings(df))


# -- dominance


def test_dominance_is_strict(spark):
    the_ok(category_dominance.findings(column(spark, ["a"] * 9 + ["b"], "string")))
    found = by_column(
        category_dominance.findings(column(spark, ["a"] * 91 + ["b"] * 9, "string"))
    )
    assert found["v"]["occurrences"] == 91 and found["v"]["sample"] == ["a"]
    assert "91.00 % of the values are 'a'" in found["v"]["message"]


def test_null_is_a_category_over_all_rows(spark):
    found = by_column(
        category_dominance.findings(column(spark, [None] * 19 + ["x"], "string"))
    )
    assert found["v"]["occurrences"] == 19 and found["v"]["sample"] == [None]
    the_ok(category_dominance.findings(column(spark, [None] * 2 + ["x"] * 8, "string")))


def test_dominance_of_booleans_but_not_numbers(spark):
    df = spark.createDataFrame([(True, 1)] * 19 + [(False, 1)], "b boolean, n int")
    found = by_column(category_dominance.findings(df))
    assert set(found) == {"b"} and found["b"]["sample"] == ["true"]


def test_dominance_of_a_column_called_count(spark):
    found = by_column(
        category_dominance.findings(column(spark, ["x"] * 5, "string", "count"))
    )
    assert found["count"]["occurrences"] == 5


def test_dominance_of_chosen_columns(spark):
    df = spark.createDataFrame([("x", "y")] * 3, ["a", "b"])
    assert set(by_column(category_dominance.findings(df, columns=["b"]))) == {"b"}
    with pytest.raises(ValueError):
        category_dominance.findings(df, columns=["c"])


def test_two_values_above_a_low_threshold(spark):
    df = column(spark, ["a"] * 4 + ["b"] * 5 + ["c"], "string")
    found = category_dominance.metrics(df, threshold=0.3).collect()
    assert {(r["value"], r["n"], r["share"]) for r in found} == {
        ("a", 4, 0.4),
        ("b", 5, 0.5),
    }


# -- duplicate rows


def test_surplus_copies_are_counted(spark):
    rows = [(1, None)] * 3 + [(2, "x")] * 2 + [(3, "y")]
    df = spark.createDataFrame(rows, "a int, b string")
    (row,) = duplicate_rows.findings(df).collect()
    assert (row["status"], row["column"], row["occurrences"]) == ("LINT", None, 3)
    assert row["sample"] == [
        '{"row":{"a":1,"b":null},"count":3}',
        '{"row":{"a":2,"b":"x"},"count":2}',
    ]


def test_three_sample_rows_at_most(spark):
    df = spark.createDataFrame([(i,) for i in range(5)] * 2, "a int")
    (row,) = duplicate_rows.findings(df).collect()
    assert row["occurrences"] == 5 and len(row["sample"]) == 3


def test_rows_equal_as_groups_are(spark):
    rows = [(0.0, NAN), (-0.0, NAN)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert duplicate_rows.metrics(df).first()["surplus"] == 1
    nested = spark.createDataFrame(
        [([0.0, NAN], (1.5, None)), ([-0.0, NAN], (1.5, None)), ([0.0], (1.5, "x"))],
        "a array<double>, s struct<x:double,y:string>",
    )
    assert duplicate_rows.metrics(nested).first()["surplus"] == 1


def test_duplicate_rows_with_awkward_names_and_maps(spark):
    schema = "`a.b` int, `count` int, `t``k` map<string,int>, A int, a int"
    conf = spark.conf.get("spark.sql.caseSensitive")
    df = spark.createDataFrame([(1, 2, {"x": 1, "y": 2}, 3, 4)] * 2, schema)
    assert conf == "false"
    (row,) = duplicate_rows.findings(df).collect()
    assert row["occurrences"] == 1


# -- case variants


def test_variants_count_distinct_spellings(spark):
    values = ["abc", "ABC", "Abc", "abc", "x", None, "", "X "]
    found = by_column(case_variants.findings(column(spark, values, "string")))
    assert found["v"]["occurrences"] == 2
    assert found["v"]["sample"] == ["ABC", "abc"]


def test_variants_ignore_blanks_and_accents(spark):
    the_ok(case_variants.findings(column(spark, ["é", "e", "a", "a "], "string")))
    found = by_column(case_variants.findings(column(spark, ["É", "é"], "string")))
    assert found["v"]["occurrences"] == 1


# -- numeric text


@pytest.mark.parametrize(
    "values, occurrences",
    [
        (["1"] * 8 + ["x"] * 2, None),
        (["1"] * 81 + ["x"] * 19, 19),
        (["1"] * 10, None),
        (["1"] * 9 + ["x"] + [None] * 50 + [""] * 50, 1),
        (["1"] * 9 + [" "], 1),
        ([None, ""], None),
    ],
)
def test_numeric_share(spark, values, occurrences):
    found = numeric_text.findings(column(spark, values, "string"))
    if occurrences is None:
        the_ok(found)
    else:
        assert by_column(found)["v"]["occurrences"] == occurrences


def test_texts_that_read_as_numbers(spark):
    good = [" 1 ", "1e3", "NaN", "nan", "Infinity", "inf", "-inf", "+5", ".5", "5.", "1d"]
    good += ["\t7", "-Infinity", "INF", "  nan "]
    bad = ["1L", "0x10", "1,000", " ", "１", "n/a", "information", "nano", "-", "é1"]
    df = column(spark, good + bad, "string")
    cast = df.selectExpr("count(try_cast(v as double)) as n").first()["n"]
    row = numeric_text.metrics(df).first()
    assert row["valid"] == len(good) + len(bad)
    assert row["numeric"] == len(good) == cast


def test_numeric_text_sample_is_the_smallest_others(spark):
    values = ["1"] * 60 + ["f", "e", "d", "c", "b", "a", "a"]
    found = by_column(numeric_text.findings(column(spark, values, "string")))
    assert found["v"]["sample"] == ["a", "a", "b", "c", "d"]


# -- outliers


def test_outliers_strictly_outside(spark):
    # q1 = 2, q3 = 6, fences -4 and 12
    df = spark.createDataFrame(
        list(zip([1, 2, 3, 4, 5, 6, 7, 12], [-4, 2, 3, 4, 5, 6, 7, 8])), "a int, b int"
    )
    the_ok(iqr_outliers.findings(df))
    values = [1, 2, 2, 3, 4, 5, 6, 13]
    row = iqr_outliers.metrics(column(spark, values, "int")).first()
    assert (row["q1"], row["q3"]) == (2.0, 5.0)
    found = by_column(iqr_outliers.findings(column(spark, values, "int")))
    assert found["v"]["occurrences"] == 1 and found["v"]["sample"] == ["13"]
    assert "numbers below -2.50 or above 9.50" in found["v"]["message"]


def test_no_spread_no_check(spark):
    the_ok(iqr_outliers.findings(column(spark, [5] * 20 + [1000], "int")))
    the_ok(iqr_outliers.findings(column(spark, [None, None], "double")))


def test_nan_is_an_outlier_but_no_quartile(spark):
    values = [float(i) for i in range(1, 21)] + [NAN]
    df = column(spark, values, "double")
    row = iqr_outliers.metrics(df).first()
    assert (row["q1"], row["q3"], row["outliers"]) == (5.0, 15.0, 1)
    assert by_column(iqr_outliers.findings(df))["v"]["sample"] == ["NaN"]


def test_infinite_quartiles_are_skipped(spark):
    the_ok(iqr_outliers.findings(column(spark, [INF] * 8 + [1.0, 2.0], "double")))
    the_ok(iqr_outliers.findings(column(spark, [-INF] * 4 + [INF] * 6, "double")))
    row = iqr_outliers.metrics(
        column(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, INF], "double")
    ).first()
    assert (row["q1"], row["q3"], row["outliers"]) == (2.0, 6.0, 1)


def test_outliers_of_decimals_and_big_integers(spark):
    big = 9007199254740993
    df = spark.createDataFrame(
        [(Decimal("1.10") * i, i) for i in range(1, 12)] + [(Decimal("500.25"), big)],
        "d decimal(10,2), n bigint",
    )
    found = by_column(iqr_outliers.findings(df))
    assert found["d"]["sample"] == ["500.25"]
    assert found["n"]["sample"] == [str(big)]


def test_approximate_outliers(spark):
    df = column(spark, [float(i % 100) for i in range(2000)] + [1e6] * 3, "double")
    found = by_column(iqr_outliers.findings(df, method="approx"))
    assert found["v"]["occurrences"] == 3
    with pytest.raises(ValueError):
        iqr_outliers.findings(df, method="other")


# -- negative values


def test_negative_means_below_zero(spark):
    rows = [(-1, -0.0, Decimal("-0.01"), None), (0, NAN, Decimal("1"), "-5")]
    df = spark.createDataFrame(rows, "a int, b double, c decimal(5,2), d string")
    found = by_column(negative_values.findings(df))
    assert {k: (v["occurrences"], v["sample"]) for k, v in found.items()} == {
        "a": (1, ["-1"]),
        "c": (1, ["-0.01"]),
    }


def test_negative_sample_is_the_five_smallest(spark):
    df = column(spark, [-1, -2, -3, -4, -5, -6, -6], "smallint")
    found = by_column(negative_values.findings(df))
    assert found["v"]["sample"] == ["-6", "-6", "-5", "-4", "-3"]


def test_intervals_and_nested_values_are_no_numbers(spark):
    df = spark.sql(
        "select interval 1 day as i, interval 1 month as m, array(-1) as a, "
        "named_struct('x', -1) as s, map('k', -1) as k, date'2020-01-01' as d"
    )
    for check in (negative_values, iqr_outliers):
        the_ok(check.findings(df))


def test_awkward_names(spark):
    names = ["a.b", "count", "t`k", "it's", 'q"q', "back\\slash", "A", "a"]
    df = spark.createDataFrame([tuple([-1] * 8)], ", ".join(
        "`{}` int".format(n.replace("`", "``")) for n in names))
    assert set(by_column(negative_values.findings(df))) == set(names)


def test_all_findings_share_the_schema(spark):
    df = column(spark, [1, 2], "int")
    for check in BUILT_IN:
        found = check.findings(df)
        assert [(f.name, f.dataType) for f in found.schema] == [
            (f.name, f.dataType) for f in FINDING_SCHEMA
        ]


def test_unknown_option(spark):
    with pytest.raises(ValueError):
        numeric_text.metrics(column(spark, ["1"], "string"), middle=0.5)


def test_unusual_types(spark):
    row = (
        "select '{text}' collate UTF8_LCASE as coll, cast('abc' as binary) as bin, "
        "timestamp'2020-01-01 01:02:03.{micros}' as ts, map('a', 1) as m, "
        "interval '1' day as i, -3Y as t, cast(null as void) as nothing"
    )
    parts = [("Ab", 123456), ("Ab", 123456), ("aB", 123456), ("Ab", 123457)]
    query = " union all ".join(row.format(text=t, micros=m) for t, m in parts)
    df = spark.sql(query)
    # A row that differs by a microsecond is no duplicate; one that differs
    # only by what its collation ignores is.
    (found,) = duplicate_rows.findings(df).collect()
    assert found["occurrences"] == 2
    assert by_column(case_variants.findings(df))["coll"]["occurrences"] == 1
    assert set(by_column(empty_columns.findings(df))) == {"nothing"}
    assert by_column(negative_values.findings(df))["t"]["occurrences"] == 4


@pytest.mark.parametrize(
    "check, options",
    [
        (category_dominance, {"threshold": 0}),
        (category_dominance, {"threshold": 1.2}),
        (category_dominance, {"columns": ["n"]}),
        (case_variants, {"columns": ["n"]}),
        (case_variants, {"columns": ["none"]}),
        (iqr_outliers, {"method": "guess"}),
        (iqr_outliers, {"multiplier": -1}),
        (numeric_text, {"low": 2}),
    ],
)
def test_impossible_options(spark, check, options):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    (row,) = lint(df, [check.NAME], options={check.NAME: options}).collect()
    assert row["status"] == "ERROR"
