"""Each registered query of the core against its DuckDB twin, at the smallest size."""

import math

import duckdb
import pytest

from fluxgate.plans import catalogs, containers, times, values  # noqa: F401
from fluxgate.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_all_have_twins():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = [[plain(r[c]) for c in names] for r in df.collect()]
    res = duck.execute(ORACLES[name])
    own = [d[0] for d in res.description]
    assert sorted(own) == names
    want = [[plain(r[own.index(c)]) for c in names] for r in res.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))
