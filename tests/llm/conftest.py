import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and very long texts, ties, repeated rows and texts.
LONG = "lorem ipsum dolor sit amet " * 4000
EDGES = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "Word", "en", "s", 4), (4, "Word", "en", "s", 4), (5, "a b", "en", None, 3), (6, "  \t\n ", None, "s", 5),
    (7, LONG, "en", "s", len(LONG)), (8, LONG + "tail", "en", "s", len(LONG)), (9, "x" * 3000, "en", "s", 3000), (9, "x" * 3000, "en", "s", 3000), (10, "päöß 東京 ÀB c d 0a1b " * 9, "de", "t", 90),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Awkward documents with columns whose names clash with those that operators use."""
    rows = spark.createDataFrame(EDGES, DOCUMENTS)
    return rows.withColumns({c: F.lit(1) for c in ("bucket", "chunk", "keep", "kind", "live", "value", "row", "fp", "id", "_kept")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def pairs():
    def of(df, *columns):
        return [tuple(r) for r in df.select(*columns).collect()]

    return of
