import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text) pairs or longer tuples."""

    def make(rows):
        full = [tuple(r) + (None,) * (4 - len(r)) + ((len(r[1]) if r[1] is not None else None),) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def clashing():
    """Add columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["row_id", "name", "level", "key", "block", "rank", "total", "shard", "kept", "score", "licence", "band", "_sha", "words", "n_words"]
        return df.withColumns({n: F.lit("x") for n in names})

    return add
