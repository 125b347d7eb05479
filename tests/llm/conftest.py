import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, key int"


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text)`` or longer tuples, with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 1) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return make
