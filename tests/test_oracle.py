"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from millrace import registry
from millrace.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(df):
    cols = sorted(df.columns)
    one = lambda v: "-" if v is None or v is pd.NA or v != v else repr(round(float(v), 7) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
