"""Every registered query against its DuckDB twin.

A few twins take every month, quarter and user to be there, as at sf0.01; the sf0.001 tables have
holes.
"""

import os

import pytest

from tests import oracle
from vintagekit.plans import load_all

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, SF_DIR)
    if q.sql is None:
        df.collect()
    else:
        assert oracle.compare(df, con, q.sql) is None
    spark.catalog.clearCache()
