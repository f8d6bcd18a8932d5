import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, class string, token string, size string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of texts (ids from 0), or of (id, text) pairs, with columns of clashing names."""

    def run(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, None, "s", None, "b", "c", "t", "z") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return run


#: Nulls, blanks, repeats, ties and a long text.
ODD = [None, "", " \n\t ", "one", "one", "One two three four five six", "x" * 5000, "word " * 3000, "é ß İ ＡＢ   z", (3, "one"), (None, "one")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
