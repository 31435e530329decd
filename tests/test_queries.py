"""Every query against its SQL on the smallest tables."""

import math
import os

import pytest

from heddle.operators import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return c


def plain(rows):
    shown = lambda v: ("%.9g" % v if not math.isnan(v) else "nan") if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in row) for row in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})")
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
