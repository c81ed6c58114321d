import random
import zlib
from hashlib import sha256

import pytest
from llm_fixtures import docs, with_clashing_names  # noqa: F401
from pyspark.sql import functions as F

from plumbline.llm import butterfly_manifest as bm
from plumbline.llm.queries import op13_butterfly_manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def path(levels, at):
    """``(own place, others)`` from a leaf up."""
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        yield at - first, run[: at - first] + run[at - first + 1 :]
        at //= 16


def leaf_of(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return H(*told)


def expected(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = {}
    for row in rows:
        text = row[1]
        chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        leaf = leaf_of(row, text)
        claim = leaf_of(row, text.translate(upper)) if chosen and text is not None else leaf
        by_source.setdefault(row[3], []).append((row[0], leaf, claim))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, found = {}, []
    for source in order:
        by_source[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = tree([leaf for _, leaf, _ in by_source[source]])
    top = tree([trees[s][-1][0] for s in order])
    for k, source in enumerate(order):
        for at, (doc, leaf, claim) in enumerate(by_source[source]):
            steps = [*path(trees[source], at), *path(top, k)]
            node = claim
            for place, others in steps:
                node = H(*others[:place], node, *others[place:])
            found.append(
                (
                    doc,
                    leaf,
                    trees[source][-1][0],
                    top[-1][0],
                    H(*(o for _, others in steps for o in others)),
                    node,
                    node == top[-1][0],
                )
            )
    return found


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(df, levels):
    leaf = [bm.field(n) for n in ("doc_id", "source", "lang", "n_chars", "text")]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate("text", capitals, capitals.lower())
    told = F.concat(F.octet_length("text").cast("string"), F.lit(":"), low)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(chosen, bm.digest([*leaf[:-1], F.coalesce(told, F.lit("-"))]))
    return bm.manifest(df, "doc_id", "source", bm.digest(leaf), claim, levels)


def found_of(df):
    df = df.withColumnRenamed("id", "doc_id")
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def some_rows(sizes, seed=4):
    rng = random.Random(seed)
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["Some Text é", "lower", "", None, f"Number {doc}"])
            rows.append((doc, text, rng.choice(["en", None]), source, rng.choice([None, 5])))
            doc += rng.choice([1, 1, 3])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees_are_those_built_one_by_one(docs, levels):
    """Sizes about the powers of the fanout, so that last runs are short or one."""
    sizes = {None: 1, "": 2, "a": 16, "b": 17, "é": 33, "c": 256, "B": 257, "z": 700}
    rows = some_rows(sizes)
    rows += [(None, "no id", "en", "b", 1), (None, "Also NONE", "en", "b", 1)]
    rows += [rows[0]] * 2 + [(rows[1][0], "another text", None, rows[1][3], 9)]
    got = manifest_of(with_clashing_names(docs(rows, 7)), levels).audit()
    assert found_of(got) == sorted(expected(rows), key=repr)


def test_several_rounds_with_short_subtrees(docs):
    """A block a run: 4,500 leaves are 282 blocks, three rounds of exchange."""
    rows = some_rows({"a": 4500, "b": 16 * 17 + 1}, 9)
    got = manifest_of(docs(rows, 5), 1).audit()
    assert found_of(got) == sorted(expected(rows), key=repr)


def test_many_keys(docs):
    rows = some_rows({f"s{k}": 1 + k % 3 for k in range(300)}, 2)
    got = manifest_of(docs(rows, 3), 1).audit()
    assert found_of(got) == sorted(expected(rows), key=repr)


def test_one_row_and_none(docs):
    rows = [(5, "A", "en", "s", 1)]
    assert found_of(manifest_of(docs(rows), 3).audit()) == expected(rows)
    empty = manifest_of(docs([]), 3)
    assert empty.audit().count() == 0 and empty.root() is None


def test_keys_beyond_the_broadcast(docs, monkeypatch):
    monkeypatch.setattr(bm, "BROADCAST_KEYS", 0)
    rows = some_rows({"a": 40, None: 3, "b": 1})
    assert found_of(manifest_of(docs(rows), 2).audit()) == sorted(expected(rows), key=repr)


def test_groups_of_the_exchange_are_small(spark):
    """Every block gets all roots of its run, from at most as many senders."""
    for blocks in (1, 2, 16, 17, 31, 33, 256, 257, 300, 513):
        states = spark.range(blocks).selectExpr(
            "'t' as tree", "id as block", f"{blocks}L as blocks"
        )
        span = 1
        while span < blocks:
            sent = bm.messages(states, span)
            groups = {}
            for r in sent.collect():
                groups.setdefault((r["party"], r["seat"]), []).append(r["digit"])
            for block in range(blocks):
                party, seat = block // (16 * span), block % span
                heads = range(party * 16 * span, min(blocks, (party + 1) * 16 * span), span)
                assert sorted(groups[party, seat]) == list(range(len(heads)))
            assert sum(map(len, groups.values())) <= 2 * max(blocks, 16 * span)
            span *= 16


def test_what_is_tampered_with_is_found(spark, sf_dir):
    got = op13_butterfly_manifest(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = [tuple(r[n] for n in names) for r in rows]
    assert found_of(got) == sorted(expected(plain), key=repr)
    assert got.where("not verified").count() > 0
