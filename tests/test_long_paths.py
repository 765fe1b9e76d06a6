"""Distances over more arcs than the eight of the query's SQL."""

from pathlib import Path

import duckdb

from weft.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_distances_equal_the_sql_carried_on(spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    with_, select = ORACLES["weighted_distances"].rsplit("\nSELECT", 1)
    more = "".join(f", w{k + 1} AS (SELECT source, id, min(d) AS d FROM (SELECT * FROM w{k} UNION ALL SELECT source, tgt, d + cost FROM w{k} JOIN c ON id = src) GROUP BY ALL)" for k in range(8, 25))
    want = {(a, b): d for a, b, d in con.execute(f"{with_}{more}\nSELECT{select.replace('FROM w8', 'FROM w25')}").fetchall()}
    got = {(r.source, r.id): r.d for r in QUERIES["weighted_distances"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) == 355
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)
