import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog near the river bank today " * 3), (2, None), (3, ""), (4, " \n\t "), (None, "nobody owns this text at all"), (None, None), (5, long), (5, long), (6, "one"), (6, "two words"), (7, "é́ ss <|endoftext|> \r\n x"), (8, "the quick brown fox jumps over the lazy dog near the river bank today " * 3)]
    extra = [(i, t, None, "s", i, "k", 1.5, True, [1, 2], "run") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n long, key string, score double, good boolean, tokens array<long>, run string")


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return odd_documents.filter("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def some(spark):
    """Tables of the data folder by name."""
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
