"""From raw documents to packed sequences, in stages.

Each stage is one operator of ``plumbline.llm`` applied to all that the stage
before it kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import release, without, written
from plumbline.llm.decontamination import verdicts
from plumbline.llm.harmonic_packing import pack
from plumbline.llm.ngram_join import ngram_firsts
from plumbline.llm.pii_boosting import redacted
from plumbline.llm.quality_ftrl import kept as good_enough

# Near duplicates: words in a shingle, and percent of the union in common.
SHINGLE, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_enough(docs, labels.select("doc_id", F.col("quality").alias("label")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Documents without words are no duplicates. Rows of one id and text are one
    document; rows of one id, or without one, and different texts are several.
    """
    found = written(ngram_firsts(docs, SHINGLE, PERCENT))
    release(spark)
    kept = without(docs, found.where("not first"))
    if found.where("first and n > 1").isEmpty():
        return kept
    kept = kept.withColumn("copy of its id", F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", "copy of its id"]).drop("copy of its id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = verdicts(docs, items).where("contaminated").select("doc_id", "copy")
    return without(docs, written(found))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the names of its kinds."""
    return redacted(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of packed sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", decontaminate),
    ("personal_data", redact),
    ("harmonic_packing", pack_tokens),
]

# Trained models take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
