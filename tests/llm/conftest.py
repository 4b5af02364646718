import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
    T.StructField("size", T.StringType()),
])

ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4),
    (4, "Same words here twice.", "en", "b", 22), (4, "Same words here twice.", "en", "b", 22),
    (None, "no id at all, but words.", "en", "b", 24), (None, None, None, "b", None),
    (5, "12 34 ### $$$", None, "a", 13), (6, "Été à Ñandú — ÉTÉ\x0bword\x0cother", "fr", None, 27),
    (7, "one two three four five " * 4000, "en", "a", 96000),
    (8, "x" * 60000, "en", "a", 60000), (9, "Same words here twice.", "en", "b", 22),
]


def frame(spark, rows):
    """Documents of (id, text, lang, source, n_chars), with columns whose names results also use."""
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    return frame(spark, ODD)


@pytest.fixture
def empty(spark):
    return frame(spark, [])
