import pytest

from lodestone.plans import catalog

from .helpers import connect, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
NO_CASE = {"respellings_in_text": {"primed", "capitals"}}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    """Every column is computed, and none is empty but those that these tables have no case of."""
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0 and {c for c in got.columns if got[c].isna().all()} <= NO_CASE.get(name, set())


def test_sql_has_queries():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert e.oracle_sql().keys() <= e.queries().keys()
