import public_tokenizers
import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def piece_path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, lang="en", start=0):
        rows = [(start + i, t, lang, "src", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)
    return make
