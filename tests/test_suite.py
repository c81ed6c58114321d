import json
import os

import pytest

import plumbline
from plumbline import lint, lint_paths

ALL = list(plumbline.available_checks())


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(-1, "x"), (2, "y"), (3, None)], "n int, s string")


@pytest.fixture
def own_check():
    names = []

    def add(name, code, fn):
        plumbline.register_check(name, code, fn)
        names.append(name)

    yield add
    for name in names:
        plumbline.unregister_check(name)


def test_every_check_reports_in_order(df):
    found = lint(df).collect()
    assert [r["check"] for r in found] == ALL
    assert [r["code"] for r in found] == [f"DL00{i}" for i in range(1, 9)]


def test_lints_come_in_column_order(spark):
    df = spark.createDataFrame([(-1, -2, -3)], "c int, a int, b int")
    assert [r["column"] for r in lint(df, ["negative_values"]).collect()] == ["c", "a", "b"]


def test_chosen_order_and_repeats(df):
    chosen = ["negative_values", "unnamed_columns", "negative_values"]
    found = lint(df, chosen).collect()
    assert [r["check"] for r in found] == chosen
    assert found[0] == found[2]


def test_unknown_check_is_an_error_row(df):
    found = lint(df, ["nope", "negative_values"]).collect()
    assert (found[0]["code"], found[0]["status"]) == ("DL000", "ERROR")
    assert found[0]["message"] == "no check of this name"
    assert found[1]["status"] == "LINT"


def test_nothing_chosen(df, spark):
    with pytest.raises(ValueError):
        lint(df, [])
    with pytest.raises(ValueError):
        lint_paths(spark, [])


def test_check_that_cannot_be_planned(spark):
    df = spark.sql("select parse_json('1') as v, -1 as n")
    found = {r["check"]: r for r in lint(df).collect()}
    assert found["duplicate_rows"]["status"] == "ERROR"
    assert found["duplicate_rows"]["code"] == "DL000"
    assert found["negative_values"]["status"] == "LINT"
    assert found["empty_columns"]["status"] == "OK"


def test_bad_options_are_an_error_row(df):
    found = lint(
        df,
        ["iqr_outliers", "negative_values"],
        options={"iqr_outliers": {"method": "guess"}, "negative_values": {"x": 1}},
    ).collect()
    assert [r["status"] for r in found] == ["ERROR", "ERROR"]


def test_own_check(df, own_check):
    def rows_below(df, limit):
        return df.where(f"n < {limit}").selectExpr("'n' as column", "'low' as message")

    own_check("rows_below", "X1", rows_below)
    assert plumbline.available_checks()["rows_below"] == "X1"
    found = lint(
        df, ["rows_below", "negative_values"], options={"rows_below": {"limit": 3}}
    ).collect()
    assert [(r["code"], r["status"], r["column"]) for r in found] == [
        ("X1", "LINT", "n"),
        ("X1", "LINT", "n"),
        ("DL008", "LINT", "n"),
    ]
    with pytest.raises(ValueError):
        plumbline.register_check("negative_values", "X2", rows_below)


def test_own_check_that_raises(df, own_check):
    def broken(df):
        raise KeyError("no such thing")

    own_check("broken", "X3", broken)
    found = lint(df, ["broken", "negative_values"]).collect()
    assert [r["status"] for r in found] == ["ERROR", "LINT"]
    assert "no such thing" in found[0]["message"]


def test_failure_while_running(df, own_check):
    own_check("late", "X4", lambda df: df.selectExpr("raise_error('late') as message"))
    found = lint(df, ["negative_values", "late", "empty_columns"], isolate="run").collect()
    assert [r["status"] for r in found] == ["LINT", "ERROR", "OK"]


def test_run_isolation_without_failures(df):
    chosen = ["negative_values", "empty_columns"]
    assert lint(df, chosen, isolate="run").collect() == lint(df, chosen).collect()


def test_without_samples(df):
    assert all(r["sample"] == [] for r in lint(df, ["negative_values"], samples=False).collect())


def test_summary_and_gate(df):
    found = lint(df, ["negative_values", "nope", "empty_columns"])
    assert tuple(plumbline.summary(found, 1.234).first()) == (3, 1, 1, 1, 1.23)
    assert plumbline.gate(found).first()["failed"] is True
    clean = lint(df, ["empty_columns"])
    assert plumbline.gate(clean).first()["failed"] is False
    assert plumbline.gate(clean.limit(0)).first()["failed"] is False


def test_report_lines(spark):
    df = spark.createDataFrame([("x", None)] * 4, "a string, b string")
    found = lint(df, ["category_dominance", "empty_columns"], path="/data/set/t.csv")
    assert [r["line"] for r in plumbline.report_lines(found).collect()] == [
        "set/t.csv | DL003 | LINT | a: 100.00 % of the values are 'x'",
        "set/t.csv | DL003 | LINT | b: 100.00 % of the values are 'null'",
        "set/t.csv | DL002 | LINT | b: column holds nothing but nulls",
    ]


def test_written_report(df, tmp_path):
    target = str(tmp_path / "report")
    plumbline.write_report(lint(df, path="/d/t.csv"), target, elapsed_seconds=2)

    def lines(part):
        folder = os.path.join(target, part)
        return [
            json.loads(line)
            for name in sorted(os.listdir(folder))
            if name.endswith(".json")
            for line in open(os.path.join(folder, name), encoding="utf-8")
        ]

    assert [r["check"] for r in lines("findings")] == ALL
    assert lines("findings")[0]["column"] is None
    (counts,) = lines("summary")
    assert counts["total_results"] == 8 and counts["total_lints"] == 1
    assert counts["elapsed_seconds"] == 2.0


def test_document_holds_totals_time_and_results(spark, tmp_path):
    df = spark.createDataFrame([(-1, "a"), (2, "A")], "n int, s string")
    path = str(tmp_path / "report.json")
    findings = lint(df, path="/d/t.csv")
    plumbline.write_document(findings, path)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["report.json"]
    document = json.loads(open(path, encoding="utf-8").read())
    rows = [r.asDict() for r in findings.collect()]
    assert document["results"] == rows
    assert document["total_results"] == len(rows)
    assert document["total_lints"] == sum(r["status"] == "LINT" for r in rows)
    assert document["elapsed_seconds"] > 0
    with pytest.raises(FileExistsError):
        plumbline.write_document(findings, path)
    plumbline.write_document(findings.where("false"), path + "2", elapsed_seconds=3)
    empty = json.loads(open(path + "2", encoding="utf-8").read())
    assert empty["results"] == [] and empty["elapsed_seconds"] == 3


def test_files_are_linted_at_the_same_time(spark, tmp_path):
    """Findings come in the order of the files, a broken one among them."""
    import time

    paths = []
    for k in range(12):
        path = str(tmp_path / f"f{k}.parquet")
        spark.range(k + 1).selectExpr("-id - 1 as n").write.parquet(path)
        paths.append(path)
    paths.insert(5, str(tmp_path / "missing.parquet"))
    names = [os.path.basename(p) for p in paths]

    def run(at_once):
        started = time.perf_counter()
        rows = lint_paths(spark, paths, ["negative_values"], at_once=at_once).collect()
        return rows, time.perf_counter() - started

    run(1)  # code is loaded and compiled
    one_by_one, slow = run(1)
    together, fast = run(8)
    assert [r["file_name"] for r in together] == names
    assert together == one_by_one
    assert [r["status"] for r in together].count("ERROR") == 1
    assert fast < slow
    with pytest.raises(ValueError):
        lint_paths(spark, paths, at_once=0)
