import pytest

BASE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) with columns whose names clash with those of results."""

    def documents(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None, 7, "x", True) for r in rows]
        return spark.createDataFrame(full, f"{BASE}, kept int, score string, component_id boolean").repartition(parts)

    return documents
