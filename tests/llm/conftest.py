import pytest
from corpus_samples import CLASH


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, source), with extra columns whose names the operators use inside."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
        return spark.createDataFrame([(i, t, None, s, None, *[f"x{k}" for k in range(len(CLASH))]) for i, t, s in rows], schema)

    return make
