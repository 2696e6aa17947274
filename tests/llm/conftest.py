import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, fp string, score string, cell string, q_words int, q_by int, t_raw int, copy string, shard_id string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, 0, "k", 1, "f", "s", "c", 2, 3, 4, "y", "z") for i, t, s in rows], DOCS)

    return make


LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, a null doc_id, a null source."""
    same = "the same text stands here twice and once more for all to see"
    return make_docs([(1, None, "a"), (2, "", "a"), (3, same, "a"), (3, same, "a"), (4, same, "b"), (None, "no id at all", "b"), (5, LONG, None), (6, " \n\t ", "a"), (7, "naïve “quotes” – çok güzel 漢字 \U0001f600 é", "c")])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
