"""Small tables with the cases that every operator of the subpackage defines."""

import pytest

#: Columns of documents, then some whose names operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, ids string, runs int, q string, _key string, fingerprint string, part int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards mix a potion of old roots and bring it to the town before the first light of day comes up again"


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "k", "i", 1, "q", "x", "f", 2)


EDGES = [
    _row(1, PROSE),
    _row(2, None),
    _row(3, ""),
    _row(4, " \t\n "),
    _row(5, "word"),
    _row(6, LONG),
    _row(7, PROSE),
    _row(8, PROSE + " end"),
    _row(9, "Zwei drei vier", None, None),
    _row(None, PROSE, "de", "b"),
    _row(None, None, None, None),
    _row(12, "same row"),
    _row(12, "same row"),
    _row(13, "naïve ﬁ ▁x  　 \x00 end\r\n\x0b tab", "fr", None),
    _row(14, "!!! 123 ###", "en", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
