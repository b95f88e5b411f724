import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1),
    (2, "alpha beta gamma delta epsilon zeta eta theta", None, "s", 1),
    (3, None, "en", None, None),
    (4, "", "en", "s", 0),
    (5, " \n\t ", "en", "s", 3),
    (6, "one", "en", "s", 3),
    (7, LONG, "en", "s", None),
    (8, "naïve café 中文 😀 " * 9, "fr", "s", 5),
    (8, "naïve café 中文 😀 " * 9, "fr", "s", 5),
    (9, "spam " * 3000, "en", "s", 5),
    (None, "a text without an id stands here as well", "en", "s", 5),
    (11, "mail me at jo@ex.com or +1 (202) 555-0143 now", "en", "s", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
