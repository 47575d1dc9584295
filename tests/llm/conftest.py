import pytest
from made_texts import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may go wrong, and two columns named like results."""
    base = words(1, 60)
    rows = [
        (1, " ".join(base), "en", "a", 1),
        (2, " ".join(base), "en", "b", 2),
        (3, " ".join([*base[:59], "other"]), "en", None, 3),
        (3, " ".join([*base[:59], "other"]), "en", None, 3),
        (4, None, None, "a", None),
        (5, "", "de", "b", 0),
        (6, " \t\n ", "de", "b", 4),
        (7, " ".join(words(2, 30_000)), "fr", "a", 5),
        (8, "x" * 100_000, "fr", "a", 6),
        (None, "no id here at all", "en", "c", 7),
        (None, None, None, None, None),
        (9, "Été ÇA 日本 <|endoftext|> don't\x1cstop", "fr", "ä", 8),
        (10, "Write to jo.doe@mail.example.com or 10.0.0.255 now", "en", "c", 9),
        (11, "one", "en", "c", 3),
        (12, "one two", "en", "c", 7),
    ]
    return spark.createDataFrame([(*r, -1, "k") for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
