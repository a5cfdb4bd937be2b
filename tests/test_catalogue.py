"""Every query of the catalogue against its SQL in another engine."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in DATA.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(frame.columns)
    result = duck.execute(SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in frame.select(columns).collect()), key=repr) == expected
