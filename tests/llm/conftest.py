import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text, source) rows, with columns that clash with inner names."""

    def make(rows):
        full = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]
        df = spark.createDataFrame(full, DOCS)
        names = ("length", "rep", "key", "size", "rows", "offset", "values", "score", "component")
        return df.withColumns({n: F.lit(7) for n in names})

    return make
