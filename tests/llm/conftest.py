import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, t1 string, fp int, _text string"


@pytest.fixture
def documents(spark):
    """documents([(doc_id, text), ...]): with null other columns and extra ones that clash with internal names."""

    def make(rows, lang=None):
        full = [(i, t, lang(i, t) if lang else None, None, len(t) if t is not None else None, "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


#: Null and empty texts, ties, repeated rows, a null id, and a long text.
ODD = [
    (1, None), (2, ""), (3, "   \n"), (None, "no id here"), (4, "tie one two three"), (5, "tie one two three"),
    (5, "tie one two three"), (6, "ab " * 60_000), (7, "Ünï code 日本 😀 x@y.zz +1 (743) 555-3824"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def nothing(documents):
    return documents([])
