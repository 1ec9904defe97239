"""Each query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from driftline.plans import catalog, catalog_delivery, catalog_flow, catalog_more, catalog_pages, catalog_records, catalog_stages  # noqa: F401  (the others add their queries to the first)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = db.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(norm(x[names.index(c)]) for c in columns) for x in found.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
