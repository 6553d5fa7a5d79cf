import pytest

#: Nulls in any column, empty and white-space texts, ties and repeated rows, and a text without spaces.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, "s", 4),
    (None, "one two three four five six seven", "en", None, None),
    (4, "one two three four five six seven", "en", "s", 33),
    (4, "one two three four five six seven", "en", "s", 33),
    (5, "x" * 5000, "en", "s", 5000),
    (6, "Ünïcödé 😀 ﬀ naïve\r\nΑθήνα", "el", "s", 1),
]


@pytest.fixture
def odd(spark):
    """Odd documents, with columns whose names the operators use for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({n: F.lit("clash") for n in ("_uid", "n_words", "fp", "score", "quality", "ids", "entities", "words", "file", "failed", "size", "key")})


@pytest.fixture
def none(odd):
    return odd.where("false")


@pytest.fixture
def long_text():
    return " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
