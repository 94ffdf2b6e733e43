import pytest
from pyspark.sql import functions as F

#: Columns whose names meet those the operators work with or return.
CLASHING = ["shard", "slot", "w", "n", "e", "i", "j", "q", "size", "text_key", "_key", "_base", "_row", "uid", "label", "score", "kept", "group", "a.b", "back`tick"]
WORDS = [f"w{i}" for i in range(400)]


def passage(at, n=60):
    return " ".join(WORDS[at : at + n])


ODD_DOCS = [
    (1, "", "en", "a"), (2, None, "en", "a"), (None, "text without an id, and mail a@b.example", "en", "a"), (4, "   \n\t ", None, None),
    (5, passage(0, 60), "en", "a"), (6, passage(0, 60), "en", "a"), (6, passage(0, 60), "en", "a"), (7, passage(3, 60), None, "b"),
    (8, "ünïcödé 汉字 😀 <|endoftext|> 's don't +1 (555) 010-9999", "fr", "b"), (9, "1", "en", ""), (10, "word " * 30000, "en", "c"), (11, "same", "de", None), (11, "another text", "de", None),
    (12, "x" * 50000, "en", "c"), (13, "1" * 30000, "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
