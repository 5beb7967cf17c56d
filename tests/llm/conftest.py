import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from texts, or (doc_id, text) pairs, with columns that clash with results."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)

    return make


def words_of(rng, n, size=400):
    """Words drawn from a vocabulary of ``size`` invented words."""
    return [f"{'bcdfghjklm'[k % 10]}{'aeiou'[k % 5]}{'nprst'[k // 5 % 5]}{k}" for k in (rng.randrange(size) for _ in range(n))]
