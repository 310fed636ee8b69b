import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with the given texts and ids from 0, with a further column whose name clashes with what operators make."""

    def make(texts, langs=None):
        schema = T._parse_datatype_string(DOCUMENTS + ", score string, spans string")
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated and long texts, and odd characters."""
    long = "one two three four five six seven " * 9000
    return [None, "", " ", "\n\n  \n", "a", "İéK ſ 中文 🎉", "same text here", "same text here", long, "x" * 30000, "<|endoftext|> token=abcdef12 <|endoftext|>", "\x00\x1c nul"]
