import os
import random
import re
import time

import pytest
from llm_fixtures import docs, vocabulary, with_clashing_names  # noqa: F401

from plumbline.llm import pii_boosting as P

BASE = {"email": P.EMAIL, "ip": P.IP, "card": P.CARD, "phone": P.PHONE}


def plain(text):
    """The base spans, by one search for each kind."""
    found = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and P.luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    bits = ["a", "@", ".", "-", "b.c", "1", "4242424242424242", " ", "+", "(", ")", "é"]
    bits += ["256", "10.0.0.1", "+1 (555) 123-4567", "x@y.z", "@@", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert P.base_spans(text) == plain(text), text


def test_spans_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = P.spans(docs).collect()
    assert len(found) == docs.count()
    for row in found:
        spans = list(zip(row["kinds"], row["starts"], row["ends"], row["base"]))
        assert [s[:3] for s in spans if s[3]] == plain(row["text"])
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), s[1]))


@pytest.fixture(scope="module")
def model(docs):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        number = f"{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        rows.append(
            (
                k,
                f"mail {name}.{k}@{name}.org or call +1 (555) {number} from "
                f"10.{k % 256}.7.{k % 200} in version 3.{k}.1 we met at noon. Then {k}",
            )
        )
    return P.fit(docs(rows))


def test_trees_tell_forms_apart(model):
    text = "write to jan.doe(at)mail.org now, we met at noon. Then"
    start = text.index("jan")
    sure = P.features(text, "email", start, start + len("jan.doe(at)mail.org"))
    number = P.features("version 3.17.1 is", "ip", 8, 14)
    import numpy as np

    high, low = model.trees.margin(np.array([sure, number], float))
    assert high > low
    added = P.added_spans(text, [], model)
    assert all(s >= start for _, s, _ in added)


def test_redaction_covers_all_spans(docs):
    rows = [(1, "a x@y.org b +1 555 123 4567 c 10.0.0.1"), (2, None), (3, ""), (4, "ok")]
    got = P.redacted(with_clashing_names(docs(rows)))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {1: "a <email> b <phone> c <ip>", 2: None, 3: "", 4: "ok"}
    assert got.columns == with_clashing_names(docs(rows)).columns
    assert P.spans(docs([])).count() == 0


def test_odd_rows(docs):
    rows = [(None, "x@y.org"), (5, "9" * 40_000), (5, "9" * 40_000), (6, "@" * 9)]
    found = P.spans(docs(rows)).collect()
    assert sorted(len(r["kinds"]) for r in found) == [0, 0, 0, 1]


def test_wide_emails_are_those_of_the_pattern():
    rng = random.Random(8)
    bits = ["a", "@", " at ", "(at)", "[dot]", ".", " dot ", "b.c", " ", "é", "%", "\t"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        plain = [(m.start(), m.end()) for m in P.WIDE["email"].finditer(text)]
        assert list(P.wide_emails(text)) == plain, text


def test_spans_that_overlap_are_found_like_one_by_one():
    rng = random.Random(9)
    for _ in range(500):
        spans = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(40) for _ in range(6))]
        s = rng.randrange(40)
        e = s + rng.randrange(1, 5)
        assert P.Covered(spans).meets(s, e) == any(s < e2 and s2 < e for s2, e2 in spans)
    assert not P.Covered([]).meets(0, 5)


@pytest.mark.parametrize("unit", ["a", "7", "a.", "7.", "7 ", "a@", "0"])
def test_long_runs_take_a_time_in_proportion(unit):
    text = f"x@y {unit * (200_000 // len(unit))} 1.2.3.4"
    start = time.perf_counter()
    found = P.candidates(text)
    P.Covered((s, e) for _, s, e in P.base_spans(text))
    assert found
    assert time.perf_counter() - start < 5


def test_parts_of_many_zeros_are_numbers():
    text = "0" * 5000 + "1.2.3.4"
    assert P.base_spans(text) == [("ip", 0, len(text))]


def crowd(n):
    """Texts of phones and numbers, and a rare form in a single one."""
    rng = random.Random(6)
    rows = []
    for k in range(n):
        number = f"{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((k, f"call +1 (555) {number} or a@b{k}.org, version 3.{k}.1 of {k}.{k}.7.8"))
    return rows


def cells_of(spark):
    from plumbline.llm.common import shared_folder

    at = shared_folder(spark).removeprefix("file://")
    last = max(os.scandir(at), key=lambda f: f.stat().st_mtime_ns).path
    return spark.read.parquet(last)


def test_all_candidates_are_learned_from(spark, docs):
    texts = crowd(4500)
    P.fit(docs(texts, 3))
    assert "n" in cells_of(spark).columns
    wanted = sum(1 for _, text in texts for _ in P.judged(text))
    assert cells_of(spark).agg({"n": "sum"}).first()[0] == wanted > 3 * 4500


def test_trees_of_a_table_are_those_of_cells_at_once(docs, monkeypatch):
    import numpy as np

    rows = docs(crowd(300), 3)
    monkeypatch.setattr(P, "ROUNDS", 2)
    one = P.fit(rows)
    monkeypatch.setattr(P, "CELLS", 0)
    other = P.fit(rows.repartition(5))
    assert one.thresholds == other.thresholds
    for a, b in zip(one.trees.rounds, other.trees.rounds, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
