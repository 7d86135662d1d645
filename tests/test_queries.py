"""Every registered query that SQL can express against DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from seqloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    def f(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(map(f, r)) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    d = registry.queries()[name](spark, sf)
    cols = sorted(d.columns)
    got = d.select(*cols).collect()
    if name not in registry.oracle_sql():
        assert got
        return
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert norm(map(tuple, got)) == norm(tuple(r[i] for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["chrom", "genomic_start", "genomic_end", "category"]
    assert set(e.oracle_sql()) <= set(e.queries())
