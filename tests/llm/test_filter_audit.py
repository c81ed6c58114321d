import random
import re
from itertools import permutations

import pytest
from llm_fixtures import docs, with_clashing_names  # noqa: F401

from plumbline.llm.filter_audit import FILTERS, filter_audit, order_audit

LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """The failing filters of each ``(doc_id, text, lang)``."""
    found = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc is not None and any(
            o is not None and o < doc and (t or "") == text for o, t, _ in rows
        ):
            fails.add("E")
        found.append(fails)
    return found


def expected(rows, labels):
    fails = failures(rows)
    found = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [k for k, row in enumerate(rows) if (row[2] or "") == part]
        shares = dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            there = set(own)
            for step, name in enumerate(order, 1):
                failing = {k for k in own if name in fails[k]}
                removed = there & failing
                there -= removed
                marks = [
                    sum(
                        any(d == rows[k][0] and x[mark] == 1 for d, *x in labels if d is not None)
                        for k in removed
                    )
                    for mark in (0, 1)
                ]
                shares[name] += len(removed)
                found[part, "".join(order), step] = [
                    len(there),
                    len(removed),
                    len(failing - removed),
                    sum(fails[k] == {name} for k in own),
                    *marks,
                ]
        for (p, order, step), counts in found.items():
            if p == part:
                counts.append(shares[order[step - 1]])
    return found


def rows_of(df):
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {
        (r["part"], r["filter_order"], r["step"]): [r[n] for n in names]
        for r in df.collect()
    }


def texts(rng):
    words = [f"w{k}" for k in range(400)]
    found = ["", None, "A\x0bB\x0cC", "é" * 30 + " A", "   ", "x" * 10000]
    for _ in range(40):
        some = rng.sample(words, 120) if rng.random() < 0.6 else rng.choices(words[:30], k=130)
        text = rng.choice([" ", "\n", "\t  "]).join(some)
        text = text.upper() if rng.random() < 0.3 else text
        found.append(text + rng.choice(["", "", " 50 %", " |"]))
    return found


def test_counts_are_those_of_walking_every_order(spark, docs):
    rng = random.Random(5)
    some = texts(rng)
    rows = [(k, rng.choice(some), rng.choice(["en", "de", None])) for k in range(90)]
    rows += [(None, some[8], "en"), (None, some[8], "en"), (3, rows[3][1], "de"), (5, "two", "")]
    rows += [rows[7]] * 3
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 90, 2)]
    labels += [(2, 1, 1), (None, 1, 1), (1000, 1, 1)]
    df = docs([(d, t, lang, None, None) for d, t, lang in rows], 5)
    got = filter_audit(with_clashing_names(df), spark.createDataFrame(labels, LABELS))
    assert rows_of(got) == expected(rows, labels)


def test_a_part_without_failures_has_rows_of_nothing(spark, docs):
    text = " ".join(f"w{k}" for k in range(200))
    df = docs([(1, text, "en", None, None)])
    got = rows_of(filter_audit(df, spark.createDataFrame([], LABELS)))
    assert len(got) == 600
    assert set(map(tuple, got.values())) == {(1, 0, 0, 0, 0, 0, 0)}


def test_no_documents_no_rows(spark, docs):
    assert filter_audit(docs([]), spark.createDataFrame([], LABELS)).count() == 0


def test_any_filters(spark):
    """The folds by themselves, with three filters and given cells."""
    cells = [("p", 0b011, 5, 2, 1), ("p", 0b100, 7, 0, 0), ("p", 0, 1, 1, 0), ("q", 0b111, 2, 0, 2)]
    schema = "part string, mask int, n long, good long, toxic long"
    got = rows_of(order_audit(spark.createDataFrame(cells, schema), "XYZ"))
    assert len(got) == 2 * 6 * 3
    assert got["p", "XYZ", 1] == [8, 5, 0, 0, 2, 1, 3 * 5]
    assert got["p", "XYZ", 2] == [8, 0, 5, 0, 0, 0, 3 * 5]
    assert got["p", "XYZ", 3] == [1, 7, 0, 7, 0, 0, 6 * 7]
    assert got["q", "ZXY", 3] == [0, 0, 2, 0, 0, 0, 2 * 2]


def test_no_python_and_few_rows_beyond_the_cells(spark, docs):
    df = docs([(k, f"text {k % 7}", "en", None, None) for k in range(50)])
    plan = filter_audit(df, spark.createDataFrame([], LABELS))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("hot", ["text", "id"])
def test_hot_groups(spark, docs, hot):
    """A third of the rows are one text, or have one id."""
    rows = [(k, f"text number {k}", "en") for k in range(200)]
    if hot == "text":
        rows += [(1000 + k, "one text", "en") for k in range(100)]
    else:
        rows += [(7, f"other {k % 9}", "en") for k in range(100)]
    labels = [(7, 1, 0), (1003, 1, 0)]
    got = filter_audit(
        docs([(d, t, lang, None, None) for d, t, lang in rows], 4),
        spark.createDataFrame(labels, LABELS),
    )
    assert rows_of(got) == expected(rows, labels)
