import pytest

LONG = "Zeile eins für alle Welt und mehr\n" * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "The first line of this text\nshort\nA second line of this text", "en", "a", 10, "x"),
        (2, "the FIRST line of this text  \nother words stand here", "en", None, None, "y"),
        (2, "the FIRST line of this text  \nother words stand here", "en", None, None, "y"),
        (3, None, None, None, None, None),
        (4, "", "de", "b", 0, ""),
        (5, LONG, "de", "b", len(LONG), "z"),
        (None, "A second line of this text", "en", "a", 1, "q"),
        (6, "12345 ... 678", None, "c", 3, "r"),
        (7, "\n\n  \n", "de", "c", 3, "r"),
        (8, "ÄÖÜ ÉÈ Straße\x0b\x1f été là", "fr", "c", 3, "r"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
