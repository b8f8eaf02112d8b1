import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table (with a clashing extra column) from (doc_id, text) rows."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 7) for i, t in rows],
                                     "doc_id long, text string, digest string, id int")
    return make


def fields(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())
