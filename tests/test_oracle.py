"""Every registered query with SQL, value for value, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sellerlens.catalog import registry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("key", list(registry().entries))
def test_query(spark, duck, key):
    e = registry().entries[key]
    df = e.run(spark, FOLDER)
    if e.sql is None:
        df.count()
    else:
        assert differences(df, duck, e.sql) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["supplierArticle", "qty", "PriceWithDiscount", "stock"]
    assert df.count() > 0


def test_every_query_has_sql():
    own = set(registry().entries)
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())
