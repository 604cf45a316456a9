"""Every driver query of the language against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from keyfold.queries import KEYS, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(str([getattr(x, "item", lambda x=x: x)() for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else None if v != v else str(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in row))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in KEYS:
        con.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
