"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from immunoscan.plans.catalogue import ORACLES, QUERIES
from immunoscan.plans.learning import FITTED

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) - set(FITTED) == set(ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "events", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols, ignore_index=True).fillna(-9).astype(str) for x in (got, want))
    assert got.equals(want)
