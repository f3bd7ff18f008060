import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, cell long, v string, h string, label int, doc string, th string, run string, `begin` string, row string, key string, own string, whole string, _own string, _th string, _own_th string, bits string, component string, node string, term string, y string, _id string, home string, kind string"


@pytest.fixture
def make(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""
    def make_(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, "v", "h", 2, *["x"] * 19) for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return make_


@pytest.fixture
def odd(make):
    """Nulls, empty and blank texts, ties, repeated rows, and one very long text."""
    long = " ".join(f"w{k % 977}" for k in range(30000))
    return make([None, "", "  \n ", "the same text here now", "the same text here now", long, "Ünïcode — 漢字 😀 text", "last"], [1, 2, 3, 4, 4, 5, None, 6])


@pytest.fixture
def empty(odd):
    return odd.where("false")
