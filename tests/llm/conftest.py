import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty texts, only white space, one word, a long word, a very long text, ties and repeated rows.
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "one", "en", "b", 3),
    (5, "ONE two three four FIVE six seven", "en", "b", 33),
    (5, "ONE two three four FIVE six seven", "en", "b", 33),
    (6, "x" * 3000, "de", None, 3000),
    (7, "être ou ne pas être, là est la question " * 400, "fr", "c", 16000),
    (8, "12345 !!! ...", None, "c", 13),
    (9, "one two three four five six seven", "en", "b", 33),
    (None, "a row without an id", "en", "a", 19),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", F.lit("x").alias("size"), F.lit(1).alias("key"), F.lit(2.5).alias("score"),
                     F.lit("y").alias("row"), F.lit("z").alias("pattern"), F.lit("w").alias("ident"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    from tests.conftest import SF_SMALL
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
