import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, prefix="w", size=500):
    return [f"{prefix}{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) pairs, with an extra column whose name clashes with internal ones."""

    def build(rows, extra=True):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("doc", "n_removed", "late", "row", "c", "h", "words", "text_", "score"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (4, "one"), (None, "two three"), (5, "é ß　x 日本 \U0001f600")]


@pytest.fixture
def odd():
    return list(ODD)
