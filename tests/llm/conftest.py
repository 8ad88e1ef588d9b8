import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Texts, or (doc_id, text, source) rows, as a documents table."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (i, r, "a") for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in full], SCHEMA)

    return make


@pytest.fixture
def clashing():
    """The same rows with more columns, under names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["row", "key", "rank", "place", "size", "score", "words", "copies", "line", "found", "count", "lang_pred", "rejected", "node", "start"]
        return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))

    return add
