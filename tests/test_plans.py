"""What the plans have to look like, whatever the data."""

import random

import pytest

from plumbline import lint
from plumbline.operators import BUILT_IN, iqr_outliers


def rows_read(spark, run):
    """Rows all scans together read while ``run`` runs."""
    store = spark._jsc.sc().statusStore()
    jvm = spark._jvm
    convert = jvm.scala.jdk.javaapi.CollectionConverters.asJava
    empty = jvm.java.util.ArrayList

    def stages():
        none = spark._sc._gateway.new_array(jvm.double, 0)
        listed = store.stageList(empty(), False, False, none, empty())
        return {s.stageId(): s.inputRecords() for s in convert(listed)}

    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = set(stages())
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for i, n in stages().items() if i not in before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def faulty(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [
        (
            i % 700,
            r.gauss(0, 1) ** 5,
            r.choice(["a", "A", "b"]),
            "x" if i % 20 == 0 else str(i % 50),
            "most" if i % 15 else "rest",
            None,
        )
        for i in range(1400)
    ]
    rows += rows[:200]
    schema = "k int, x double, cv string, nt string, dom string, e string"
    path = str(tmp_path_factory.mktemp("plans") / "faulty.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_scans_of_the_whole_suite(spark, faulty):
    """Counters and sketches 1, brackets 1, values 2, rows 2, samples 1 and 1."""
    n = faulty.count()
    assert {r["status"] for r in lint(faulty).collect() if r["code"] != "DL001"} == {"LINT"}
    # The one-row frames that carry small results count as well.
    assert rows_read(spark, lint(faulty).collect) <= 8 * n + 50
    options = {"iqr_outliers": {"method": "approx"}}
    fewer = lint(faulty, options=options, samples=False)
    assert rows_read(spark, fewer.collect) <= 8 * n + 50


@pytest.mark.parametrize(
    "check, scans",
    [
        ("empty_columns", 1),
        ("negative_values", 2),
        ("case_variants", 2),
        ("duplicate_rows", 2),
        ("numeric_text", 2),
        ("category_dominance", 2),
        ("iqr_outliers", 3),
    ],
)
def test_scans_of_one_check(spark, faulty, check, scans):
    n = faulty.count()
    assert scans * n <= rows_read(spark, lint(faulty, [check]).collect) <= scans * n + 9


def test_no_python_and_no_cross_joins(faulty):
    for found in (lint(faulty), lint(faulty, options={"iqr_outliers": {"method": "approx"}})):
        plan = plan_of(found)
        for word in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan


def test_numeric_checks_read_numeric_columns_only(faulty):
    plan = plan_of(iqr_outliers.metrics(faulty))
    assert "ReadSchema: struct<k:int,x:double>" in plan
    assert "cv:string" not in plan


def test_building_a_plan_runs_no_job(spark, faulty):
    assert rows_read(spark, lambda: [c.metrics(faulty) for c in BUILT_IN]) == 0
    assert rows_read(spark, lambda: lint(faulty)) == 0


def test_wide_tables_take_several_passes(spark):
    names = [f"c{i}" for i in range(150)]
    df = spark.createDataFrame([tuple([-1] * 150)], ", ".join(f"{n} int" for n in names))
    found = lint(df, ["empty_columns", "negative_values"], samples=False).collect()
    assert [r["column"] for r in found[1:]] == names


def test_many_equal_columns_plan_quickly(spark):
    """The optimizer must not enumerate aliases of hashed columns."""
    import time

    df = spark.range(10).selectExpr(*[f"id as c{i}" for i in range(60)])
    start = time.time()
    lint(df, ["duplicate_rows"])._jdf.queryExecution().optimizedPlan()
    assert time.time() - start < 20
