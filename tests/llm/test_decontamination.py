import random
import re

import pytest
from llm_fixtures import docs, vocabulary, with_clashing_names  # noqa: F401

from plumbline.llm.decontamination import (
    contamination,
    index,
    phrase_hits,
    proximity_hits,
)

ITEMS = "item_id long, text string"


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, size):
    tests = set()
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            tests.add((item, tuple(w[i : i + size])))
    found = {}
    for doc, text in docs:
        w, hit, which = words_of(text), set(), set()
        for item, window in tests:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    which.add(str(item))
        bad = bool(hit) and 20 * len(hit) >= len(w)
        found[doc] = (len(w), len(hit), sorted(which), bad)
    return found


def answers(df):
    return {
        r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"])
        for r in df.collect()
    }


@pytest.mark.parametrize("size", [3, 13])
def test_hits_are_those_of_a_plain_search(spark, docs, size):
    rng = random.Random(size)
    pool = ["the", "of", "É", "é", "Straße", "a1", "x", "ΣΑΣ", "İx", "dog"]
    texts = [
        rng.choice([" ", ", ", "-"]).join(rng.choice(pool) for _ in range(rng.randrange(60)))
        for _ in range(60)
    ]
    items = [(k, texts[k][: rng.randrange(5, 80)]) for k in range(0, 20, 2)]
    items += [(100, None), (101, ""), (102, "dog"), (102, "THE of")]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "the " * 5000)]
    got = contamination(docs(rows), spark.createDataFrame(items, ITEMS), size)
    assert answers(got) == brute(rows, items, size)


def test_empty_tables_ties_and_clashing_columns(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "one two three"), (2, "one two three")], ITEMS)
    rows = [(1, "so one two three it is"), (1, "so one two three it is"), (None, "one")]
    assert contamination(docs([]), some, 3).count() == 0
    assert {a[1] for a in answers(contamination(docs(rows), none, 3)).values()} == {0}
    got = contamination(with_clashing_names(docs(rows)), with_clashing_names(some), 3)
    assert answers(got) == {1: (6, 3, ["1", "2"], True), None: (1, 0, [], False)}


def test_proximity_finds_scattered_terms(spark, docs):
    items = spark.createDataFrame([(1, "red green blue")], ITEMS)
    rows = [(1, "blue x green y red"), (2, "red " + "x " * 9 + "green blue"), (3, "red")]
    found, tests, n = index(docs(rows), items, 3, reach=6)
    near = proximity_hits(found, tests, n, within=6)
    assert [r["doc_id"] for r in near.collect()] == [1]
    assert phrase_hits(found, tests, n).where("start is not null").count() == 0


def test_a_shuffle_join_gives_the_same(spark, docs, monkeypatch):
    from plumbline.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    items = spark.createDataFrame([(1, "alpha beta gamma")], ITEMS)
    got = contamination(docs([(1, "alpha beta gamma delta")]), items, 3)
    assert answers(got) == {1: (4, 3, ["1"], True)}


def test_no_python_runs(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma")], ITEMS)
    got = contamination(docs([(1, "alpha beta gamma delta")]), items, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_items_without_id_hit(spark, docs):
    from plumbline.llm import decontamination

    phrase = " ".join(f"q{k}" for k in range(15))
    items = spark.createDataFrame(
        [(None, phrase), (3, "q0 q1 q2")], "item_id long, text string"
    )
    table = docs([(1, f"so {phrase} it is"), (2, "nothing of it"), (None, phrase)])
    got = decontamination.contamination(table, items).collect()
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in got}
    assert found == {
        1: (15, 2, ["3"], True),
        2: (0, 0, [], False),
        None: (15, 2, ["3"], True),
    }
