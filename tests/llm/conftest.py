import pytest
from tricky_texts import TRICKY


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns of clashing names."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0) for i, t in enumerate(TRICKY)]
    rows += [(None, "a row without id here", None, None, None), (3, "one", "en", "s0", 0)]
    return spark.createDataFrame([(*r, 1, 2, 3, "t") for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, n long, key long, rep long, hashes string")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
