"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillgate.plans import catalog

SF = "/root/testdata/sf0.001"
RUN, SQL = catalog.queries(), catalog.oracles()
SLOW = {"rect_components", "bbox_locate", "bbox_lines"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = RUN[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    ref = con.execute(SQL[name])
    columns = [c[0] for c in ref.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.columns, got) == canon(columns, ref.fetchall())


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert RUN[name](spark, SF).count() > 0
