import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (id, text, source); further columns have names that operators use inside."""
    def make(rows, extra=False):
        full = []
        for i, r in enumerate(rows):
            key, text, source = r if isinstance(r, tuple) else (i, r, f"src{i % 3}")
            full.append((key, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("size", "n", "sid", "rank", "_text", "pii", "n_words", "target", "slot", "h", "ids", "matches"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df
    return make


ODD = [None, "", " \t\n", "word", "a b c", "Straße É ñ", "x" * 5000, "same text here twice", "same text here twice", "\x0b\x0c\r mixed\u00a0blank"]


@pytest.fixture(scope="session")
def odd():
    return ODD
