"""Each registered query against its SQL twin."""

import datetime
from pathlib import Path

import duckdb
import pytest

from corvidex.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        rel = duck.execute(ORACLES[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
        assert len(got) == len(want)
        assert got == want
