import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def edge_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", None, 4),
        (None, "one two three", "fr", "b", 13),
        (5, long, "en", "a", len(long)),
        (6, long + " end", "en", "b", len(long) + 4),
        (7, "É" * 300 + " 'quoted' ۳  x", "de", "b", 310),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("k", "t", "id", "grp", "salt", "block", "key", "n", "bucket"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
