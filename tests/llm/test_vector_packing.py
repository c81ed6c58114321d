import random
import zlib

import numpy as np
import pytest
from llm_fixtures import docs, with_clashing_names  # noqa: F401

from plumbline.llm.vector_packing import Capacity, Words, best_fit, pack

END = "<|endoftext|>"
TEXTS = [
    "",
    None,
    "a",
    "Hello  WORLD\n\n  it's  \t end ",
    "naïve café 東京 👍 x² é ́e İstanbul ΑΣ",
    f"a{END}b {END} <|startoftext|>c <|ENDOFTEXT|>",
    "one\x1ctwo\x1d three\x1f \x85 four five six",
    "word " * 9000,
    "x" * 5000,
    "12345 6.7!?",
]


@pytest.fixture(scope="module")
def words_file():
    module = pytest.importorskip("public_tokenizers")
    return module.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of(words_file):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(words_file)
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(words_file, ids_of):
    rng = random.Random(2)
    signs = [" ", "  ", "\n", "ab", "Zé", "'s", "12", "!?", "\t", "\x1e", "ǅ", "́", "İ", END]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(40)) for _ in range(300)]
    words = Words(open(words_file, encoding="utf-8").read())
    for _ in range(2):  # also with words remembered
        for text in texts:
            assert np.frombuffer(words.ids(text or ""), "<u4").tolist() == ids_of(text), text


def test_letters_taken_apart_here_are_those_of_the_tokenizer(words_file, ids_of):
    """Each sign of the plain ones, and some beyond, alone and between others."""
    words = Words(open(words_file, encoding="utf-8").read())
    for code in [*range(0x21, 0x250), 0x3A3, 0x1E9E, 0x2126, 0x212B, 0xFB01]:
        sign = chr(code)
        for text in (sign, f"ab{sign}cd", f"1{sign}2", f"it'{sign}s", f"!{sign}?", sign * 3):
            assert np.frombuffer(words.ids(text), "<u4").tolist() == ids_of(text), repr(text)


def checked(placed, capacity):
    """Sequences of a packing; asserts that none is over full and none has gaps."""
    found = placed.groupby("sequence_id")
    for _, rows in found:
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]]
        assert rows.length.sum() <= capacity.tokens
        assert len(rows) <= capacity.documents
        assert (rows.length**2).sum() <= capacity.attention
    return len(found)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_id_lies_in_one_piece(docs, words_file, ids_of, rule):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id"), (2**60 + 1, "large id")]
    df = with_clashing_names(docs(rows, 3))
    got = pack(df, words_file, rule=rule).toPandas()
    for doc, text in rows:
        ids = np.array([*ids_of(text), 1], "<u4")
        own = got[got.doc_id.isna() if doc is None else got.doc_id == doc]
        own = own.sort_values("piece")
        copies = 2 if doc == 3 else 1
        assert own.length.sum() == copies * len(ids)
        assert set(own.doc_tokens) == {len(ids)}
        if copies == 1:
            assert own.piece.tolist() == list(range(-(-len(ids) // 4096)))
            assert (own.length.iloc[:-1] == 4096).all()
        for p in own.itertuples():
            assert p.start == 4096 * p.piece
            piece = ids[p.start : p.start + p.length]
            assert len(piece) == p.length
            assert zlib.crc32(piece.tobytes()) == p.ids_crc32
    checked(got, Capacity())


def test_large_ids_beside_null_ids(docs, words_file):
    large = 2**60 + 1
    got = pack(docs([(large, "a"), (None, "b")], 1), words_file).collect()
    assert {r["doc_id"] for r in got} == {large, None}


def test_no_documents_no_pieces(docs, words_file):
    assert pack(docs([]), words_file).count() == 0
    with pytest.raises(ValueError):
        pack(docs([]), words_file, rule="first")
    with pytest.raises(ValueError):
        pack(docs([]), words_file, capacity=Capacity(documents=0))


def test_every_constraint_holds(docs, words_file):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randrange(0, 300)) for k in range(400)]
    for capacity in (
        Capacity(256, 4, 256**2),
        Capacity(256, 1000, 20_000),
        Capacity(1000, 7, 90_000),
    ):
        for rule in ("norm", "dot"):
            got = pack(docs(rows, 4), words_file, capacity, (1.0, 1.0, 1.0), rule)
            got = got.toPandas()
            checked(got, capacity)
            assert got.length.sum() == sum(len(t.split()) + 1 for _, t in rows)
            assert got.length.max() <= capacity.longest


def plain_best_fit(lengths, capacity, weights, rule):
    """One bin after the other, in plain numbers."""
    bins, sequence, offset = [], [], []
    for n in lengths:
        takes, best = (n, 1, n * n), None
        for k, room in enumerate(bins):
            if all(r >= t for r, t in zip(room, takes)):
                each = zip(room, takes, capacity, weights)
                if rule == "norm":
                    score = sum(w * ((r - t) / c) ** 2 for r, t, c, w in each)
                else:
                    score = sum(w * (r / c) * (t / c) for r, t, c, w in each)
                best = min(best, (score, k)) if best else (score, k)
        k = best[1] if best else len(bins)
        if not best:
            bins.append(list(capacity))
        sequence.append(k)
        offset.append(capacity[0] - bins[k][0])
        bins[k] = [r - t for r, t in zip(bins[k], takes)]
    return bins, sequence, offset


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_by_brute_force(rule):
    """Both fill each sequence alike, whichever of two equal ones is taken."""
    rng = random.Random(3)
    for _ in range(30):
        capacity = Capacity(100, rng.choice([3, 50]), rng.choice([2000, 10_000]))
        lengths = sorted((rng.randrange(1, 45) for _ in range(80)), reverse=True)
        weights = (1.0, 0.3, 0.2)
        bins, _, _ = plain_best_fit(lengths, capacity, weights, rule)
        sequence, offset = best_fit(np.array(lengths), capacity, weights, rule)
        used = np.bincount(sequence, lengths).astype(int)
        assert sorted(used) == sorted(capacity.tokens - b[0] for b in bins)
        for k in range(len(lengths)):
            before = [n for n, s in zip(lengths[:k], sequence[:k]) if s == sequence[k]]
            assert offset[k] == sum(before)


def test_few_sequences(spark, sf_dir, words_file):
    got = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_file).toPandas()
    n = checked(got, Capacity())
    assert n <= 1.02 * got.length.sum() / 4096 + 1


def test_groups_are_packed_by_themselves(spark, docs, words_file, monkeypatch):
    monkeypatch.setattr("plumbline.llm.vector_packing.GROUP", 50)
    # A third of the rows have one id.
    rows = [(7 if k % 3 == 0 else k, "w " * (k % 90)) for k in range(600)]
    got = pack(docs(rows, 6), words_file, Capacity(128, 100, 128**2)).toPandas()
    checked(got, Capacity(128, 100, 128**2))
    groups = got.groupby(got.sequence_id // 2**32).size()
    assert len(groups) == 12 and groups.max() < 90
    assert got.length.sum() == sum(len(t.split()) + 1 for _, t in rows)
