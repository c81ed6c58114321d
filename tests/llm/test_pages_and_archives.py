import hashlib
import random

import pytest
from llm_fixtures import docs, with_clashing_names  # noqa: F401

from plumbline.llm import merkle_fixity, spot_signatures
from plumbline.llm.suffix_boilerplate import (
    ARTICLE,
    FURNITURE,
    OPEN,
    Parser,
    main_text,
)

PAGES = "page_id long, url string, html string"


def test_blocks_know_their_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head>
    <body class="x"><!-- ad --><div class="cookie-notice">We use cookies</div>
    <header><h1>Site</h1></header><div><p>Loose &lt;text&gt;&nbsp; here</p></div>
    <article><header><h1>Title</h1></header><p><b>One<br>two<p>three <b>bold</b>
    <aside>see also</aside><section id="comments"><p>nice!</p></section>
    <script>var t="</p>";</script>end</article><form><input> q</form><footer>foot"""
    assert Parser().blocks(page) == [
        (FURNITURE, "We use cookies"),
        (FURNITURE, "Site"),
        (OPEN, "Loose <text> here"),
        (ARTICLE, "Title"),
        (ARTICLE, "One two"),
        (ARTICLE, "three bold"),
        (FURNITURE, "see also"),
        (FURNITURE, "nice!"),
        (ARTICLE, "end"),
        (FURNITURE, "q"),
        (FURNITURE, "foot"),
    ]


def test_repeated_runs_of_a_host_go_and_unique_ones_stay(spark):
    shell = "<p>Welcome to our great little shop of things</p><p>{}</p><p>All offers are without any warranty of course</p>"
    own = ["alpha beta gamma delta", "one two three four five six seven", "x"]
    rows = [(k, "http://a.example/%d" % k, shell.format(t)) for k, t in enumerate(own)]
    rows += [(10, "http://b.example/", shell.format("alone"))]
    rows += [(11, "http://c.example/1", "<p>the same page in two places of it</p>")]
    rows += [(12, "http://c.example/2", "<p>the same page in two places of it</p>")]
    found = {
        r["page_id"]: r["text"]
        for r in main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    }
    assert [found[k] for k in range(3)] == own
    assert found[10].splitlines()[1] == "alone" and len(found[10].splitlines()) == 3
    assert found[11] == found[12] == "the same page in two places of it"


def test_copied_articles_stay(spark):
    page = "<nav><a>Home of all</a></nav><article><p>{}</p></article>"
    rows = [(k, "http://a.example/", page.format("a b c d e f g h i j " * 9)) for k in range(4)]
    found = main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert {r["text"] for r in found} == {("a b c d e f g h i j " * 9).strip()}
    assert {r["n_chars"] for r in found} == {179}


def test_odd_pages(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "x y", "<"),
        (None, "http://h/", "plain & simple &am"),
        (5, "http://h/", "<div>" * 3000 + "deep" + "<p>x</p>" * 20_000),
        (6, "http://h/", "<article>a</article>"),
        (6, "http://h/", "<article>a</article>"),
    ]
    df = with_clashing_names(spark.createDataFrame(rows, PAGES))
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in main_text(df).collect()]
    assert len(found) == len(rows)
    by_id = {k: (t, n) for k, t, n in found}
    assert by_id[1] == by_id[2] == ("", 0)
    assert by_id[6] == ("a", 1) and by_id[None][0] == "plain & simple &am"
    assert main_text(df.where("false")).count() == 0


# -- fixity


def records(spark, rows):
    return spark.createDataFrame(rows, "file long, number int, record string")


def test_audit_finds_what_differs(spark):
    rng = random.Random(6)
    own = [(f, n, f"record {f} {n} " * rng.randrange(9)) for f in range(3) for n in range(300)]
    changed = dict(enumerate(own))
    wrong = {}
    for k in rng.sample(range(len(own)), 25):
        f, n, text = own[k]
        kind = rng.choice(["altered", "resized", "missing"])
        if kind == "altered" and not text:
            kind = "resized"
        if kind == "missing":
            del changed[k]
        else:
            changed[k] = (f, n, "#" + text[1:] if kind == "altered" else text + "!")
        wrong[f, n] = kind
    extra = [(2, 5000, "new"), (9, 0, "file")]
    wrong |= {(2, 5000): "added", (9, 0): "added"}
    found = merkle_fixity.audit(
        with_clashing_names(records(spark, own)), records(spark, [*changed.values(), *extra])
    ).collect()
    assert {(r["file"], r["number"]): r["fault"] for r in found} == wrong
    at = {}
    for f in range(3):
        total = 0
        for _, n, text in own[300 * f : 300 * f + 300]:
            at[f, n] = total
            total += len(text)
    for r in found:
        assert r["offset"] == at.get((r["file"], r["number"]))
        if r["fault"] != "added":
            text = own[300 * r["file"] + r["number"]][2]
            assert r["expected"] == hashlib.sha256(text.encode()).hexdigest()


def test_sound_and_odd_archives(spark):
    rows = [(1, 0, None), (1, 1, ""), (1, 1, ""), (1, 2, "a"), (1, 2, "b"), (None, 0, "x")]
    some = records(spark, rows).repartition(2)
    assert merkle_fixity.audit(some, records(spark, rows[::-1])).count() == 0
    none = some.where("false")
    assert merkle_fixity.audit(none, none).count() == 0
    assert merkle_fixity.audit(some.where("file = 1"), none).count() == 3


def test_pages_become_records(spark):
    rows = [(1, None, None), (5000, "http://u", "é")]
    found = merkle_fixity.warc_records(spark.createDataFrame(rows, PAGES)).collect()
    assert [(r["file"], r["number"]) for r in found] == [(0, 1), (1, 904)]
    assert found[1]["record"].endswith("Content-Length: 2\r\n\r\né\r\n\r\n")


# -- fingerprints


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def answers(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in df.collect()), key=str)


def test_edited_texts_over_many_slices(docs, monkeypatch):
    monkeypatch.setattr(spot_signatures, "SLICE_ROWS", 7)
    rng = random.Random(8)
    rows = [(k * 3, "wörd the of " * rng.randrange(9)) for k in range(100)]
    rows += [(None, "null id"), (33, "again"), (33, "again"), (500, None), (501, "")]
    table = with_clashing_names(docs(rows, 5))
    assert answers(spot_signatures.fingerprints(table)) == brute(rows)


def test_likeness_of_fingerprints(docs):
    text = "the quick brown fox of a lazy dog and the old grey cat in the deep wood " * 3
    rows = [(1, text), (2, text), (3, text.replace("grey", "white")), (4, "x y"), (5, None)]
    found = {r["doc_id"]: r for r in spot_signatures.fingerprints(docs(rows)).collect()}
    assert found[1]["fingerprint"] == found[2]["fingerprint"]
    assert found[1]["near_next"] == 1.0 and 0.3 < found[2]["near_next"] < 1.0
    assert found[3]["near_next"] == 0.0
    assert found[5]["fingerprint"] == spot_signatures.EMPTY
    a = spot_signatures.decoded(found[2]["fingerprint"])
    b = spot_signatures.decoded(found[3]["fingerprint"])
    assert found[2]["near_next"] == len(a & b) / len(a | b)
    assert answers(spot_signatures.fingerprints(docs([(7, "only one")]))) == brute([(7, "only one")])
    assert spot_signatures.fingerprints(docs([])).count() == 0


def test_near_copies_are_alike_whatever_the_number_of_spots():
    hasher = spot_signatures.Hasher()
    anchors = spot_signatures.anchor_hashes(hasher)
    rng = random.Random(9)
    for n in range(4, 30):
        # n anchors of the list among 300 other words; the copy has one less.
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        places = rng.sample(range(10, 290), n)
        for k in places:
            words[k] = "the"
        less = [w for k, w in enumerate(words) if k != places[0]]
        a, b = spot_signatures.spots(hasher, anchors, [" ".join(words), " ".join(less)])
        assert spot_signatures.likeness(a, b) > 0.85, n


def test_altered_records_without_file_or_number_are_found(spark):
    schema = "file long, number int, record string"
    own = [(None, 0, "a"), (None, 1, "b"), (None, None, "c"), (0, 0, "d"), (0, 0, "e"), (-1, 5, "f")]
    other = [(None, 0, "a"), (None, 1, "B"), (None, None, "C"), (0, 0, "e"), (0, 0, "d"), (-1, 5, "g")]
    wrong = merkle_fixity.audit(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema))
    found = {(r["file"], r["number"], r["offset"], r["fault"]) for r in wrong.collect()}
    assert found >= {(None, 1, 1, "altered"), (-1, 5, 0, "altered")}
    assert {r[:2] for r in found} == {(None, 1), (None, None), (-1, 5)}


def test_negative_ids_and_files_that_are_too_long(spark):
    pages = spark.createDataFrame([(-1, "u", "h"), (None, "u", "h")], "page_id long, url string, html string")
    placed = {(r["file"], r["number"]) for r in merkle_fixity.warc_records(pages).collect()}
    assert placed == {(-1, 4095), (None, None)}
    with pytest.raises(ValueError):
        merkle_fixity.warc_records(pages, 1 << 17)
