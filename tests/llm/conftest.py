import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 60_000


@pytest.fixture(scope="session")
def make(spark):
    """Documents of texts, with columns whose names the operators use."""

    def docs(texts, langs=None, ids=None):
        rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", "s", None if t is None else len(t), 1, 2.5, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA + ", fp long, score double, text_bytes string")

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty, blank, very long, repeated and tied texts; null ids."""
    texts = [None, "", " \n\t ", LONG, "ein Satz", "ein Satz", "x", "ä" * 3000, "1 2 3", "Ein\x1csatz\xa0hier", "!!!"]
    ids = [0, 1, 2, 3, 4, 4, None, 7, 8, 9, 10]
    return make(texts, [None, "en", "de", "de", None, "de", "en", "xx", "en", "de", "en"], ids)


@pytest.fixture(scope="session")
def none(make, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
