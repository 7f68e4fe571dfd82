import pytest

EXTRA = ["key", "rules", "n", "text_sha256", "uid", "words", "group", "d2", "place", "label", "kept", "token", "rank", "size", "first", "known"]
LONG = "long words go on and on " * 4000


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "same text here", "en", "a"), (1, "same text here", "en", "a"), (2, "same  text\there", None, "a"), (3, "same text here", "en", None),
        (None, "same text here", "en", "a"), (None, None, None, None), (4, None, "en", "a"), (5, "", "de", "a"), (6, " \n\t", "de", "b"),
        (7, LONG, "en", "b"), (8, LONG + "end", "en", "b"), (9, "123 !!", "fr", "b"), (-10, "é漢😀 mot", "fr", "c"), (2**60, "token = 'abcdefghijkl'", "en", "c"),
    ]
    full = [(*r, None if r[1] is None else len(r[1]), *range(len(EXTRA))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
