import pytest

WORDS = [f"word{i}" for i in range(300)]


def rows(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and blank texts, repeated rows, one long text, and columns named like results and internals."""
    long = "The quick brown fox. " * 3000
    data = [
        (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "  \n ", "de", None), (5, long, "en", "b"), (6, long, None, "b"),
        (7, "one two three four five six", "en", "a"), (7, "one two three four five six", "en", "a"), (None, "null id", "en", "a"), (None, None, None, None), (8, "Ünï ‍ code text <|endoftext|> x", "fr", "c"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    extra = ["n_tokens", "component_id", "digest", "key", "kept", "score", "node", "row", "piece", "length", "block", "text_key", "topic", "weight", "_scored"]
    return df.withColumns({name: F.lit("clash") for name in extra})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
