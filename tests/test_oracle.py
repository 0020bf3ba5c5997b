"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from curatrix.checks import load_all
from verify import canonical

from .conftest import SMALL

OWN = load_all()  # what other packages register is tested with them
QUERIES, ORACLE = ({name: x for name, x in part.items() if name in OWN} for part in (contract.queries(), contract.oracle_sql()))


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck):
    got = canonical(QUERIES[name](spark, SMALL).toPandas())
    assert got == canonical(duck.sql(ORACLE[name]).df())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark):
    df = QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns))
    df.write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
