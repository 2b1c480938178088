import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(folder):
    t = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, marks int, carried string, component_id int, n_words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, one id with two texts, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000)) + "\n" + "x" * 300_000
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta", "en"), (1, "alpha beta gamma delta epsilon zeta eta theta", "en"), (2, None, None),
            (3, "", "en"), (4, " \t\n\x0b ", None), (5, long, "en"), (6, long, "de"), (None, "alpha beta gamma delta epsilon zeta eta theta", "en"),
            (None, None, None), (7, "1234 5678 !!!", "en"), (8, "one", "de"), (8, "zwei drei", "de"), (9, "one", None), (10, "é ß 漢字 😀\u0085  x", "fr"),
            (11, "<|endoftext|> The the", "en"), (12, "alpha  beta\tgamma delta epsilon zeta eta theta", "en")]
    return spark.createDataFrame([(i, t, x, None, None, "s", 1, "c", 2, "n") for i, t, x in rows], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
