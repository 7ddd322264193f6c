import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (id, text) or (id, text, lang, source)."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # further columns whose names are those that operators use inside
            for name in ("id", "key", "n", "a", "b", "at", "token", "host", "row", "size", "target", "copies"):
                df = df.withColumn(name, df.text)
        return df

    return make
