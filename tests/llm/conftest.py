import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


#: Texts that are easily mishandled; long ones come to over a megabyte.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "a text without an id"), (5, "same words here " * 30), (6, "same words here " * 30), (6, "same words here " * 30), (7, "é ñ 中文 ß x " * 40), (8, "word" * 300_000), (9, "many words " * 120_000)]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "shard", "slot", "kept", "score", "posterior", "fp", "label", "piece", "start", "bucket", "n_words", "quality", "term", "__key", "__piece", "__traits", "__id", "__copy", "row", "t", "tie", "grp", "name", "h1", "no_id")
    return odd.withColumns({c: F.lit("x") for c in names})
