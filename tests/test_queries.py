import os

import duckdb
import pytest

import __spark_entry__ as entry
from ridgeline.queries import ORACLES, QUERIES

DATA = os.environ.get("RIDGELINE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def flat(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: None if x is None or x != x else round(float(x), 5) + 0.0 if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert flat(got.collect(), got.columns) == flat(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "n_events", "first_idx", "strongest"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
