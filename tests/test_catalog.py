"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from lumafold.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.astype(object).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    for frame in (ours, theirs):
        for c in frame.columns:
            if frame[c].dtype == float:
                frame[c] = frame[c].round(6) + 0.0
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
