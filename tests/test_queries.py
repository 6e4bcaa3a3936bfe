"""Every query of the catalog runs, and equals its SQL where it has one."""

import math

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if type(v).__name__ == "Decimal":
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


def key(row):
    return tuple((v is None, f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    q = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-5)), (a, b)
