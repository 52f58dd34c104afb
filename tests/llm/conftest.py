import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def corpus(small):
    """(doc_id, text) of the smallest documents table."""
    return pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


@pytest.fixture(scope="session")
def medium(small):
    """A folder with more labels than the smallest has."""
    return small.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats, ties, long and strange texts, clashing columns."""
    long = "word " * 20_000 + "x" * 50_000
    rows = [
        (1, "a b c d e f", "p"), (1, "a b c d e f", "p"), (2, "a b c d e f", None), (2, "other words here", "q"), (3, None, "r"),
        (4, "", "s"), (None, "no id at all", "t"), (None, None, None), (5, long, "u"), (6, " \n\t \n", "v"),
        (7, "<|endoftext|> it's  we'll\n\n x y  z 日本語 テスト", "w"), (8, "ÀÉÖß Straße ΣΑΣ é 😀", "x"), (9, "Released under the MIT License.", "y"),
    ]
    schema = "doc_id long, text string, score string, fingerprint int, node int, label int, start int, lang string, n_chars long"
    return spark.createDataFrame([(i, t, c, 1, 2, 3, 4, "en", None if t is None else len(t)) for i, t, c in rows], schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 10)], "doc_id long, quality int, toxic int")
