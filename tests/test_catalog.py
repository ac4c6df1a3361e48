"""Every registered query of the analytics operators against DuckDB on the smallest tables."""

import duckdb
import pytest

from locusframe.plans import catalog
from tests.compare import rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(duck.execute(catalog.SQL[name]).df())
    else:
        assert len(got.columns) > 0


def test_flagship(spark):
    assert 0 < catalog.flagship(spark, SF).count() <= 20
