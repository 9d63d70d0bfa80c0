"""Every registered query of the engine against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import catalog, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float):
        return None if isinstance(v, float) and math.isnan(v) else float(v)
    return str(v)


def rows(records, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in records)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(name, spark, sf_dir, duck):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    cursor = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert rows((r.asDict() for r in got.collect()), columns) == rows(want, columns)
