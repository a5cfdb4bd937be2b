"""The llm queries that SQL can express against another engine."""

from pathlib import Path

import duckdb
import pytest

from plumbline.llm import queries

DATA = Path("/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in DATA.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = queries.queries()[name](spark, str(DATA))
    result = con.execute(SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in frame.columns]
    assert sorted(map(repr, (tuple(r[i] for i in at) for r in result.fetchall()))) == sorted(map(repr, map(tuple, frame.collect())))
