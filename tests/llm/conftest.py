import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the evening comes and all is quiet"),
    (2, "The quick brown fox jumps over the lazy dog again and again until the evening comes and all is quiet"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "één été où les cœurs chantent"),
    (7, "word " * 30000),
    (8, "123 456 !!!"),
    (None, "a row without an id that still has some words in it"),
    (1, "the same id with another text that differs from the first one"),
    (9, "ends with surrogates \U0001f600 and tabs\tand\x0bmore"),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names operators use inside."""
    rows = [(i, x, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src", k) for k, (i, x) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("key", "fp", "component", "tag", "score", "spans", "contaminated")})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
