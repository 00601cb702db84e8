"""Every query outside the text operators gives the second engine's rows, or at least some rows where SQL cannot say it."""

import pytest

from tessera.plans import layers, numeric, sqlqueries
from tests.helpers import duck, rows

QUERIES = sqlqueries.queries() | numeric.queries() | layers.queries()
ORACLE = sqlqueries.ORACLE | numeric.ORACLE | layers.ORACLE


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, small, con, name):
    own, other = QUERIES[name](spark, small).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    for c in own.columns:  # nullable numbers are floats on one side and objects on the other
        kinds = {own[c].dtype.kind, other[c].dtype.kind}
        if kinds & {"f", "i"} and kinds != {"f"}:
            own[c], other[c] = own[c].astype("Float64").astype(object), other[c].astype("Float64").astype(object)
    assert rows(own) == rows(other)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
