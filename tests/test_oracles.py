"""Every registered query against its DuckDB oracle on the smallest driver tables (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from oracle_check import canon, duck  # noqa: E402

from kanon.plans.catalog import load_all  # noqa: E402

QUERIES, ORACLES = load_all()  # the training-data queries have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["bucket_key", "companies", "active_companies", "total_count", "share_pct"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(ORACLES[name])
    drows, dcols = cur.fetchall(), [d[0] for d in cur.description]
    assert canon(sdf.columns, sdf.collect()) == canon(dcols, drows)
