"""Every core query with SQL against DuckDB, row by row."""

import duckdb
import pytest

from twinfold.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_iterative(spark, sf):
    """Every file of a maximal duplicate has a copy that stays, and it lies in an alternate outside the duplicate."""
    alts = {(r.dir, r.alt) for r in QUERIES["dup_alts"](spark, sf).collect()}
    kept = QUERIES["file_map"](spark, sf).collect()
    assert kept
    for r in kept:
        assert r.path.startswith(r.dir) and not r.kept_path.startswith(r.dir)
        assert any(d == r.dir and (a == "." or r.kept_path.startswith(a)) for d, a in alts)
