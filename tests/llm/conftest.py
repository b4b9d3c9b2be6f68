import pytest

#: Every awkward row at once: nulls, empty, blank, long, repeated and clashing texts, and columns with the operators' own names.
LONG = "word " * 30_000 + "x" * 60_000
ROWS = [
    (1, "Alpha beta gamma delta epsilon\nAlpha beta gamma delta epsilon", "en", "s1", 5),
    (1, "Alpha beta gamma delta epsilon\nAlpha beta gamma delta epsilon", "en", "s1", 5),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, " \t\n ", "fr", "s2", 4),
    (5, "One two", "de", None, 7),
    (6, "one TWO", "de", "s2", 7),
    (None, "Alpha beta gamma delta epsilon\nAlpha beta gamma delta epsilon", "en", "s3", 5),
    (7, LONG, "en", "s1", len(LONG)),
    (8, "Größe 😀 <|endoftext|> <s> a@b.co, +1 (017) 555-7713, 10.0.0.1, 4111 1111 1111 1111", "en", "s1", 9),
    (9, "a b\r\n\r\n  c　d", "en", "s1", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("clash") for c in ("size", "node", "key", "block", "kind", "held_out", "hash", "pattern", "ids", "h", "n", "members", "copies", "mark", "row", "parts", "tie", "variant", "_kept_id", "doc")}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
