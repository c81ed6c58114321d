import os

import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark: SparkSession):
    """``docs(rows)``: a documents table of ``(doc_id, text)`` rows."""

    def make(rows, parts: int = 2):
        full = [(*r, None, None, None) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def vocabulary():
    module = pytest.importorskip("public_tokenizers")
    path = module.path("byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    return path


def with_clashing_names(df):
    """The table with columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = "key node n words pos anchor text_a score predicted place page all".split()
    return df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(names)))
