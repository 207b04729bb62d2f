from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to a table of documents; a row may be (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = [tuple(r) + ("en", "s1")[len(r) - 2 :] for r in rows]
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters."""
    long = "many words make one very long text. " * 20_000
    return [
        (1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "en", "s1"), (None, "a text without an id", "en", None), (None, None, None, None), (4, "one\ntwo\nthree\nfour", "en", "s2"), (5, "one\ntwo\nthree\nfour", "en", "s2"),
        (5, "one\ntwo\nthree\nfour", "en", "s2"), (6, long, "en", "s1"), (7, "\x00 é́ 中文 😀 ß İ <|endoftext|> 'll", None, "s3"), (8, "1234 --- !!!", "de", "s3"), (5, "the same id with another text", "en", "s2"),
    ]
