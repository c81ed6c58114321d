import random
import re

import numpy as np
import pandas as pd
import pytest
from llm_fixtures import docs, vocabulary, with_clashing_names  # noqa: F401

from plumbline.llm import ngram_join
from plumbline.llm.components import components
from plumbline.llm.ngram_join import Rule, ngram_groups


def shingles(text, words):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return frozenset()
    return frozenset(
        tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))
    )


def brute(rows, words=4, percent=85):
    sets = [(doc, shingles(text, words)) for doc, text in rows]
    group = list(range(len(sets)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                group[root(i)] = root(j)
    least = {}
    for k, (doc, s) in enumerate(sets):
        if s:
            least[root(k)] = min(least.get(root(k), doc), doc)
    return {
        (doc, len(s), least[root(k)] if s else doc) for k, (doc, s) in enumerate(sets)
    }


def edited(rng, words, share, pool):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        at = rng.randrange(len(out))
        rng.choice([out.pop, lambda i: out.insert(i, rng.choice(pool))])(at)
        if not out:
            out.append(rng.choice(pool))
    return out


def corpus(seed, n=25):
    """Originals of many lengths with families of lightly edited copies."""
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        base = [rng.choice(pool) for _ in range(rng.choice([3, 5, 9, 12, 30, 60, 150]))]
        texts.append(base)
        for _ in range(rng.randrange(8)):
            texts.append(edited(rng, rng.choice(texts[-3:]), rng.choice([0.005, 0.02, 0.05]), pool))
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def answers(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(docs, seed):
    rows = corpus(seed)
    assert answers(ngram_groups(docs(rows))) == brute(rows)


def test_one_deletion_keys_lose_nothing(docs, monkeypatch):
    def forced(self, octave, nodes):
        most = int(self.differ(2 * self.top(octave)))
        return (most + 2) // 2, True

    monkeypatch.setattr(Rule, "plan", forced)
    rows = corpus(3)
    assert answers(ngram_groups(docs(rows))) == brute(rows)


def short_copies(seed):
    """Texts of 8 to 11 words, some with a word more or less at an end."""
    rng = random.Random(seed)
    texts = []
    for k in range(60):
        base = [f"v{k}x{i}" for i in range(rng.randrange(8, 12))]
        less, more = base[1:], [*base, f"more{k}"]
        texts += [base, *rng.sample([less, more, base[:-1], ["first", *base]], 2)]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("deletions", [False, True])
def test_short_sets_link_at_five_words_and_80_percent(docs, monkeypatch, deletions):
    def forced(self, octave, nodes):
        most = int(self.differ(2 * self.top(octave)))
        return ((most + 2) // 2, True) if deletions else (int(1.25 * most + 2), False)

    monkeypatch.setattr(Rule, "plan", forced)
    rows = short_copies(4) + [(1000 + k, t) for k, t in corpus(4, 10)]
    expected = brute(rows, 5, 80)
    assert sum(n in (4, 5) and doc != least for doc, n, least in expected) > 20
    assert answers(ngram_groups(docs(rows), 5, 80)) == expected


@pytest.mark.parametrize("percent, least", [(80, 4), (85, 6), (50, 1), (90, 9)])
def test_least_size_follows_from_the_rule(percent, least):
    assert Rule(4, percent).least == least
    assert 100 * least >= percent * (least + 1)
    assert 100 * (least - 1) < percent * least


def test_costs_choose_deletions_only_where_chance_is_high():
    rule = Rule()
    assert not rule.plan(4, 1e5)[1]
    assert rule.plan(0, 1e13)[1]


def test_blocks_of_large_buckets(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(300)]
    base = [rng.choice(pool) for _ in range(80)]
    rows = [
        (k, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.08]), pool)))
        for k in range(70)
    ]
    assert answers(ngram_groups(docs(rows))) == brute(rows)


def test_odd_rows(docs):
    rows = [
        (1, None),
        (2, ""),
        (3, " \n"),
        (4, "One two"),
        (5, "one  TWO"),
        (6, "é" * 3),
        (7, "a " * 30_000),
        (8, "A " * 20_000),
        (9, "one two three"),
        (9, "one two three"),
    ]
    got = answers(ngram_groups(with_clashing_names(docs(rows))))
    assert got == brute(rows)
    assert ngram_groups(docs([])).count() == 0


def test_sets_of_null_ids_link_and_are_links(docs):
    base = [f"n{k}" for k in range(40)]
    texts = [" ".join(base[k : k + 34]) for k in range(5)]
    rows = [(4, texts[0]), (None, texts[2]), (2, texts[4]), (None, "a b c d e")]
    ends = answers(ngram_groups(docs(rows)))
    assert ends == {(4, 31, 2), (None, 31, 2), (2, 31, 2), (None, 2, None)}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)]
    edges += [(7, 7), (500, 499), (499, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert {got[k] for k in range(1, 41)} == {0}
    assert {got[200 + k] for k in range(30)} == {100}
    assert got[500] == 499
    assert components(df.where("false")).count() == 0


def test_long_sketches_are_compared_a_few_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 12_000, dtype=np.uint8)
    rows = []
    for k in range(600):
        sketch = base.copy()
        sketch[: 5 * k] += 1
        rows.append((7, 0, 0, k, k, 12_000, sketch.tobytes(), k >= 597))
    names = ["key", "i", "j", "node", "component", "size", "sketch", "aside"]
    tracemalloc.start()
    found = ngram_join.allowed(ngram_join.Rule(4, 85), pd.DataFrame(rows, columns=names), False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    limit = ngram_join.Rule(4, 85).differ(24_000)
    wanted = [(a, b) for a in range(597) for b in (597, 598, 599) if 5 * (b - a) <= limit]
    assert list(map(tuple, found.to_numpy())) == wanted
    assert peak < 50e6


def test_likeliest_pairs_tell_where_more_are():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, 400, dtype=np.uint8)
    rows = []
    for k, (key, change) in enumerate([(7, 0), (7, 2), (7, 4), (8, 0), (8, 3), (9, 0), (9, 400)]):
        sketch = base.copy()
        sketch[:change] += 1
        rows.append((key, 0, 0, k, k, 400, sketch.tobytes(), True, True))
    names = ["key", "i", "j", "node", "component", "size", "sketch", "every", "aside"]
    compare = ngram_join.blocks_compared(Rule(4, 85), True)
    found = pd.concat(compare(iter([pd.DataFrame(rows, columns=names)])))
    got = set(map(tuple, found.to_numpy().tolist()))
    # Of bucket 7 every node has two pairs, of bucket 8 one, of bucket 9 none.
    assert got == {(0, 1, 7, 1), (1, 2, 7, 1), (3, 4, 8, 0)}


@pytest.mark.parametrize("rows", [60, 9])
def test_each_pair_of_sides_meets_in_one_unit(docs, spark, monkeypatch, rows):
    """Nodes are sent once to a unit, and every node set aside meets every other."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)

    def meeting(rule, nearest):
        def compare(batches):
            for batch in batches:
                batch = batch.assign(a=batch["node"], b=batch["component"])
                batch["more"] = 2 * batch["every"] + batch["aside"]
                batch["key"] = batch["i"] * 1000 + batch["j"]
                yield batch[["a", "b", "key", "more"]]

        return compare

    monkeypatch.setattr(ngram_join, "blocks_compared", meeting)
    nodes = list(range(rows))
    members = spark.createDataFrame([(64, n) for n in nodes], "key long, node long")
    groups = spark.createDataFrame([(n, 0) for n in nodes[: rows // 3]], "node long, component long")
    sketches = spark.createDataFrame(
        [(n, 0, 9, bytearray(b"x")) for n in nodes], "node long, octave long, size long, sketch binary"
    )

    class Given:
        rule = Rule()

    units = ngram_join.residual(Given, members, groups, sketches, True).collect()
    sent = [(r["key"], r["a"]) for r in units]
    assert len(sent) == len(set(sent))
    met = []
    for r in units:
        if r["more"] & 1:
            met += [(r["a"], o["a"]) for o in units if o["key"] == r["key"] and o["more"] & 2]
    aside = nodes[rows // 3 :]
    assert sorted(met) == [(x, y) for x in aside for y in nodes]


def test_index_is_grouped_in_slices(docs, monkeypatch):
    done = []
    release = ngram_join.release
    monkeypatch.setattr(ngram_join, "release", lambda s: (done.append(1), release(s)))
    rows = corpus(6, 12)
    join = ngram_join.Join(docs(rows), Rule())
    heads, _ = join.live()
    assert len(done) >= ngram_join.SLICES
    keys = [r["key"] for r in heads.collect()]
    assert keys and len(keys) == len(set(keys))
    assert {(k >> 5) % ngram_join.SLICES for k in keys} == set(range(ngram_join.SLICES))


def sketched(n, base, changes):
    """Rows of one block, each node a group of its own and on both sides."""
    rows = []
    for k in range(n):
        sketch = base.copy()
        sketch[changes(k)] += 1
        rows.append((7, 0, 0, k, k, len(base), sketch.tobytes(), True, True))
    names = ["key", "i", "j", "node", "component", "size", "sketch", "every", "aside"]
    return pd.DataFrame(rows, columns=names)


def test_rows_grow_with_the_nodes_of_a_block_that_may_link():
    base = np.random.default_rng(3).integers(0, 256, 400, dtype=np.uint8)
    rows = sketched(300, base, lambda k: [k])
    compare = ngram_join.blocks_compared(Rule(4, 85), False)
    found = pd.concat(compare(iter([rows[:100], rows[100:]])))
    assert sorted(found["node"]) == list(range(300)) and found["cluster"].nunique() == 1
    # The same nodes of another bucket are the same cluster.
    again = pd.concat(compare(iter([rows.assign(key=8)])))
    assert set(map(tuple, again.to_numpy())) == set(map(tuple, found.to_numpy()))


def test_clusters_are_apart_where_no_pair_may_link():
    base = np.random.default_rng(4).integers(0, 256, 400, dtype=np.uint8)
    rows = sketched(6, base, lambda k: slice(0, 200) if k % 2 else [k])
    found = pd.concat(ngram_join.blocks_compared(Rule(), False)(iter([rows])))
    held = found.groupby("cluster")["node"].apply(lambda n: sorted(map(int, n)))
    assert sorted(held) == [[0, 2, 4], [1, 3, 5]]


def test_sketches_keep_links_and_leave_out_what_is_a_little_too_far():
    """Words replaced at places of their own take from a segment as many shingles as they add."""
    rng, rule = random.Random(9), Rule(5, 80)
    base = [f"w{k}" for k in range(510)]
    texts = []
    for k in range(60):
        words = base.copy()
        for place in rng.sample(range(5, 505, 5), 4 if k < 20 else 7):
            words[place] = f"x{k} {place}".replace(" ", "y")
        texts.append(" ".join(words))
    given = pd.DataFrame({"node": range(60), "text": texts})
    sketches = pd.concat(ngram_join.sketcher(rule)(iter([given])))
    sketches = sketches[sketches["octave"] == sketches["octave"].min()]
    rows = sketches.assign(key=7, i=0, j=0, component=sketches["node"], every=True, aside=True)
    found = ngram_join.allowed(rule, ngram_join.sides(rows), False)
    held = {tuple(sorted(p)) for p in found.to_numpy().tolist()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    apart = {(a, b): len(sets[a] ^ sets[b]) for a in range(60) for b in range(a + 1, 60)}
    most = {(a, b): rule.differ(len(sets[a]) + len(sets[b])) for a, b in apart}
    assert {p for p in apart if apart[p] <= most[p]} <= held
    # Bytes that differ, counted once each, would let pass most of what is a fifth too far.
    far = [p for p in apart if apart[p] > 1.2 * most[p]]
    data = np.stack([np.frombuffer(x, np.uint8) for x in rows["sketch"]])
    assert sum((data[a] != data[b]).sum() <= most[a, b] for a, b in far) > len(far) / 2 > 100
    assert len(held.intersection(far)) < len(far) / 20
    a, b = ngram_join.laid(rows["sketch"][:30]), ngram_join.laid(rows["sketch"][30:])
    assert all(x <= apart[k, 30 + k] for k, x in enumerate(ngram_join.least_apart(a, b)))


@pytest.mark.parametrize("met, cells", [(1 << 21, 1 << 22), (3000, 500)])
def test_few_links_join_a_cluster(monkeypatch, met, cells):
    monkeypatch.setattr(ngram_join, "MET", met)
    monkeypatch.setattr(ngram_join, "CELLS", cells)
    rng = random.Random(7)
    pool = [f"w{k}" for k in range(300)]
    base = [rng.choice(pool) for _ in range(80)]
    texts = [" ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.08]), pool)) for _ in range(70)]
    names = ["cluster", "node", "component", "text", "every", "aside"]
    rows = pd.DataFrame([(5, k, k, t, True, True) for k, t in enumerate(texts)], columns=names)
    found = pd.concat(ngram_join.linker(Rule())(iter([rows[:40], rows[40:]])))
    group = list(range(70))
    for a, b in found.to_numpy().tolist():
        assert group[a] != group[b]
        group = [group[a] if g == group[b] else g for g in group]
    expected = {doc: least for doc, _, least in brute(list(enumerate(texts)))}
    assert 1 < len(set(expected.values())) < 70
    assert [min(j for j in range(70) if group[j] == group[k]) for k in range(70)] == [expected[k] for k in range(70)]


def test_components_of_stars_take_no_turn(spark, monkeypatch):
    from plumbline.llm import components as module

    turns = []
    stars = module._stars
    monkeypatch.setattr(module, "_stars", lambda e: turns.append(1) or stars(e))
    edges = [(0, k) for k in range(1, 9)] + [(30 + k, 20) for k in range(5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(k, 0) for k in range(1, 9)} | {(30 + k, 20) for k in range(5)}
    assert not turns
