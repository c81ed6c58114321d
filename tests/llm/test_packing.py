import random
import zlib

import numpy as np
from llm_fixtures import docs, vocabulary, with_clashing_names  # noqa: F401

from plumbline.llm.harmonic_packing import CAPACITY, Encoder, cut, pack

TEXTS = [
    "",
    None,
    "a",
    "Hello  world\n\n  it's  \t end ",
    " lead and trail ",
    "naïve café 東京 👍 x²",
    "<|endoftext|> is text",
    "a b   c",
    "word " * 3000,
    "x" * 5000,
]


def ids_of(path, text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return whole.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_tokenizer(vocabulary):
    rng = random.Random(2)
    signs = [" ", "  ", "\n", "ab", "Zé", "'s", "12", "!?", "\t", " ", "ǅ", "़"]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(40)) for _ in range(300)]
    encoder = Encoder(open(vocabulary, encoding="utf-8").read())
    for _ in range(2):  # also with pieces remembered
        for text in texts:
            got = np.frombuffer(encoder.encode(text or ""), "<u4").tolist()
            assert got == ids_of(vocabulary, text)[:-1], text


def test_cuts_add_up():
    for n in (1, 15, 16, 17, 1023, 1024, 1025, 5000):
        found = cut(n)
        assert sum(found) == n and all(0 < x <= CAPACITY for x in found)


def test_every_id_lies_in_one_piece_and_sequences_have_no_gap(docs, vocabulary):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id")]
    got = pack(with_clashing_names(docs(rows, 3)), vocabulary).toPandas()
    for doc, text in rows:
        ids = np.array(ids_of(vocabulary, text), "<u4")
        own = got[got.doc_id.isna() if doc is None else got.doc_id == doc]
        copies = 2 if doc == 3 else 1
        assert own.length.sum() == copies * len(ids)
        assert set(own.doc_tokens) == {len(ids)}
        for p in own.itertuples():
            piece = ids[p.start : p.start + p.length]
            assert len(piece) == p.length
            assert zlib.crc32(piece.tobytes()) == p.ids_crc32
    for _, rows_ in got.groupby("sequence_id"):
        at = 0
        for p in rows_.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
        assert at <= CAPACITY
    assert pack(docs([]), vocabulary).count() == 0


def test_little_padding(spark, sf_dir, vocabulary):
    got = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
    used = got.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert used.sum() / (len(used) * CAPACITY) > 0.98


def test_added_tokens_are_those_of_a_tokenizer_at_its_defaults(docs, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    from plumbline.llm.queries import op8_harmonic_packing

    whole = Tokenizer.from_file(vocabulary)
    expected = lambda t: whole.encode(t or "", add_special_tokens=False).ids
    assert expected("a<|endoftext|>b") == [64, 50256, 65]
    end = "<|endoftext|>"
    texts = TEXTS + [f"a{end}b", end, f" {end}  {end}{end} x  ", f"a  \n{end} b", "<|endoftext"]
    rng = random.Random(3)
    signs = [" ", "  ", "ab", "\n", "'s", "<|", "|>", "endoftext", end]
    texts += ["".join(rng.choice(signs) for _ in range(30)) for _ in range(200)]
    encoder = Encoder(open(vocabulary, encoding="utf-8").read(), added=True)
    for text in texts:
        got = np.frombuffer(encoder.encode(text or ""), "<u4").tolist()
        assert got == expected(text), text
    df = docs([*enumerate(texts)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for p in op8_harmonic_packing(df.sparkSession, str(tmp_path)).collect():
        ids = np.array(expected(texts[p.doc_id]) + [0], "<u4")
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_plain_words_need_no_pattern(vocabulary):
    from tokenizers import Tokenizer

    text = open(vocabulary, encoding="utf-8").read()
    encoder, whole = Encoder(text, added=True), Tokenizer.from_str(text)
    asked, find = [], encoder._pieces
    encoder._pieces = lambda part: asked.append(part) or find(part)
    words = "Plain words, été and more. ¿x a.b, ,. \x00a ǅa ²\x1f日本 x's\nY"
    for given in (words, f" {words} ", words.replace(" a", " \x1fa"), words.replace("Y", "\n ")):
        ids = whole.encode(given, add_special_tokens=False).ids
        assert encoder.encode(given) == b"".join(i.to_bytes(4, "little") for i in ids)
    asked.clear()
    encoder.encode("one two, three. déjà")
    assert asked == ["one"]
