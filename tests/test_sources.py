import pytest

from plumbline import lint, lint_paths, read_dataset


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv_types_are_inferred(spark, tmp_path):
    path = write(tmp_path / "t.CSV", "n,s,x\n-1,a,1.5\n2,b,2.5\n")
    df = read_dataset(spark, path)
    assert df.dtypes == [("n", "int"), ("s", "string"), ("x", "double")]


def test_csv_with_a_given_schema(spark, tmp_path):
    path = write(tmp_path / "t.csv", "n,s\n1,a\n")
    assert read_dataset(spark, path, "n string, s string").dtypes[0] == ("n", "string")


def test_blank_and_repeated_headers(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'a,,b,a,""\n1,2,3,4,5\n')
    df = read_dataset(spark, path)
    assert df.columns == ["a0", "_c1", "b", "a3", "_c4"]
    found = lint(
        df, ["unnamed_columns"], options={"unnamed_columns": {"match_generated": True}}
    )
    assert [r["column"] for r in found.collect()] == ["_c1", "_c4"]


def test_header_only_and_empty_files(spark, tmp_path):
    paths = [write(tmp_path / "h.csv", "a,b\n"), write(tmp_path / "e.csv", "")]
    assert read_dataset(spark, paths[0]).dtypes == [("a", "string"), ("b", "string")]
    found = lint_paths(spark, paths).collect()
    assert len(found) == 16 and {r["status"] for r in found} == {"OK"}


def test_carriage_returns_and_trailing_blanks(spark, tmp_path):
    path = write(tmp_path / "t.csv", "Name,Total #\rA,1.50 \rB,-2.50 \r")
    found = lint_paths(spark, [path], ["negative_values"]).collect()
    assert [(r["column"], r["sample"]) for r in found] == [("Total #", ["-2.5"])]


def test_parquet_directory_and_provenance(spark, tmp_path):
    path = f"{tmp_path}/sales/part.parquet"
    spark.createDataFrame([(-1,), (1,)], "n int").write.parquet(path)
    (row,) = lint_paths(spark, [path], ["negative_values"]).collect()
    assert (row["dataset"], row["file_name"], row["path"]) == ("sales", "part.parquet", path)
    assert row["occurrences"] == 1


def test_unreadable_files_do_not_stop_the_rest(spark, tmp_path):
    good = write(tmp_path / "d" / "good.csv", "n\n-1\n")
    paths = [f"{tmp_path}/d/none.parquet", f"{tmp_path}/d/t.txt", good]
    found = lint_paths(spark, paths, ["negative_values"]).collect()
    assert [(r["code"], r["check"], r["status"]) for r in found] == [
        ("DL000", "file_read", "ERROR"),
        ("DL000", "file_read", "ERROR"),
        ("DL008", "negative_values", "LINT"),
    ]
    assert found[1]["message"].endswith("Unsupported format: .txt")
    assert [r["file_name"] for r in found] == ["none.parquet", "t.txt", "good.csv"]


def test_planted_faults_in_a_csv(spark, tmp_path):
    lines = ["id,name,age,pay,Unnamed: 4"]
    lines += [f"{i},p{i},{20 + i % 30},{3000 + i}.0," for i in range(96)]
    lines += ["96,P1,200,5.0,", "97,P2,-5,-100.0,", "97,P2,-5,-100.0,"]
    found = lint_paths(spark, [write(tmp_path / "p.csv", "\n".join(lines))]).collect()
    assert {(r["code"], r["column"], r["occurrences"]) for r in found} == {
        ("DL001", "Unnamed: 4", 1),
        ("DL002", "Unnamed: 4", 99),
        ("DL003", "Unnamed: 4", 99),
        ("DL004", None, 1),
        ("DL005", "name", 2),
        ("DL006", None, 0),
        ("DL007", "age", 3),
        ("DL007", "pay", 3),
        ("DL008", "age", 2),
        ("DL008", "pay", 2),
    }


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_dataset(spark, "x.json")
