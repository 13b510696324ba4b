import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words string, label int, unit string, token string, `rank` int, score double, __id long, __row string, __doc int, __words int, __text string, __key int, lang_pred string"
#: Extra columns whose names the operators use themselves.
EXTRA = (7, "x", 1, "u", "t", 3, 0.5, 9, "r", 1, 2, "t", 3, "p")

LINE = "the quick brown fox jumps over the lazy dog and runs along the river until it is out of sight"


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), *EXTRA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_words = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
    return [
        document(1, LINE),
        document(2, LINE),
        document(2, LINE),
        document(3, None),
        document(4, ""),
        document(5, " \t\n\r\x0b\x0c"),
        document(6, "x" * 200_000),
        document(7, long_words, "fr", "b"),
        document(8, LINE + " indeed", None, "b"),
        document(9, "Für Über ÉTÉ été 東京 ½ x²   ᠎ b́ <|endoftext|> İstanbul\tend", "de", None),
        document(None, LINE + " once more", "en", "b"),
        document(None, None, None, None),
        document(10, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n" * 3, "en", "c"),
        document(11, "one two", "en", "c"),
        document(12, "\n".join([LINE] * 8), "en", "c"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
