"""Each query that has SQL against that SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weft import catalog as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def key(row):
    return tuple("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert len(got) == len(rows)
    assert all(same(a, b) for x, y in zip(got, rows, strict=True) for a, b in zip(x, y, strict=True))
