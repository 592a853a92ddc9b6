import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            for name in ("score", "lang_pred", "ids", "key", "n", "block", "hash", "size", "item", "part", "_text"):
                df = df.withColumn(name, df.source)
        return df
    return make
