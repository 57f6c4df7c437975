import duckdb
import pytest

from fusilade.plans import queries as P

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations part events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(P.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = P.QUERIES[name](spark, SF).toPandas(), duck.sql(P.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(P.QUERIES) - set(P.ORACLES)))
def test_query_runs(spark, name):
    assert P.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
