import numpy as np
import pytest
import test_decontamination
import test_ngram_join
import test_pii
from llm_fixtures import docs, vocabulary  # noqa: F401

import corpus_pipeline as pipeline
from plumbline.llm.common import written
from plumbline.llm.quality_ftrl import quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's name, input and output, as the pipeline runs them."""
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in pipeline.STAGES:
        found[name] = (now, written(stage(spark, now, sf_dir)))
        now = found[name][1]
    return found


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns


def test_rejected_texts_go(spark, sf_dir, stages):
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.selectExpr("doc_id", "quality as label")
    good = quality(before, labels).where("predicted = 1")
    assert {r[0] for r in rows(after)} == {r["doc_id"] for r in good.collect()}


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    groups = test_ngram_join.brute(rows(before), pipeline.SHINGLE, pipeline.PERCENT)
    first = {doc for doc, _, group in groups if doc == group}
    assert rows(after) == [r for r in rows(before) if r[0] in first]


def test_contaminated_texts_go(spark, sf_dir, stages):
    before, after = stages["benchmark_decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in items]
    found = test_decontamination.brute(rows(before), items, 13)
    assert rows(after) == [r for r in rows(before) if not found[r[0]][3]]


def test_personal_data_goes(stages):
    before, after = stages["personal_data"]
    for (doc, text), (same, clean) in zip(rows(before), rows(after), strict=True):
        assert doc == same
        if not test_pii.plain(text):
            assert clean == text
        else:
            assert not test_pii.plain(clean) and clean != text


def test_all_tokens_are_packed(stages, vocabulary):
    import test_packing

    before, after = stages["harmonic_packing"]
    pieces = after.toPandas()
    expected = sum(len(test_packing.ids_of(vocabulary, t)) for _, t in rows(before))
    assert pieces.length.sum() == expected
    assert set(pieces.doc_id) == {d for d, _ in rows(before)}
    assert np.all(pieces.groupby("sequence_id").length.sum() <= 1024)


def test_odd_documents(spark, docs, sf_dir):
    odd = docs([(1, None), (2, ""), (None, "no id"), (4, "same text"), (4, "same text")])
    for table in (odd, odd.where("false")):
        now = table
        for _, stage in pipeline.STAGES:
            now = written(stage(spark, now, sf_dir))
        if table is odd:
            assert {r["doc_id"] for r in now.collect()} <= {1, 2, None, 4}
        else:
            assert now.count() == 0


def test_rows_are_told_apart_by_id_and_text(spark, docs, sf_dir):
    words = [" ".join(f"{t}{k}" for k in range(20)) for t in "abcdef"]
    rows_ = [(None, words[0]), (None, words[1]), (None, words[2]), (None, words[2])]
    rows_ += [(5, words[3]), (5, words[4]), (5, words[4]), (None, None), (None, "")]
    # Of two groups each: the later copy of one and the first of another.
    rows_ += [(1, words[5]), (6, words[5] + " more"), (6, words[0] + " more")]
    got = pipeline.keep_one_of_each(spark, docs(rows_, 3), sf_dir)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[1] is not None)
    expected = [(None, None), (None, ""), (None, words[1]), (None, words[2])]
    expected += [(1, words[5]), (5, words[3]), (5, words[4]), (6, words[0] + " more")]
    got = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key)
    assert got == sorted(expected, key=key)


def test_contaminated_text_takes_no_other_of_its_id(spark, docs, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows_ = [(None, item), (None, "clean text"), (7, item), (7, "other"), (8, "third")]
    got = pipeline.decontaminate(spark, docs(rows_), sf_dir).collect()
    left = {(r["doc_id"], r["text"]) for r in got}
    assert left == {(None, "clean text"), (7, "other"), (8, "third")}


def test_only_texts_that_may_go_are_shuffled(spark, docs):
    from pyspark.sql import functions as F

    from plumbline.llm.common import MAY, among, without

    table = docs([(k, f"text {k}") for k in range(300)] + [(None, "n"), (None, None), (7, None)], 4)
    gone = [(3, "text 3"), (None, "n"), (7, None), (9, "other text")]
    found = docs(gone).select("doc_id", F.xxhash64("text").alias("copy"))
    left = rows_of(without(table, found))
    assert left == [r for r in rows_of(table) if r not in gone]
    hashed = found.select(F.xxhash64("doc_id").alias("h"))
    told = among(table, F.xxhash64("doc_id"), hashed)
    assert told.count() == table.count() and told.where(F.col(MAY)).count() < 20
    plan = without(table, found)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert rows_of(without(table, found.where("false"))) == rows_of(table)


def rows_of(df):
    key = lambda r: (r[0] or -1, r[1] or "")
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)
