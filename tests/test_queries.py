"""Every registered query with a SQL statement gives the same rows as DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenfold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        return "nan" if math.isnan(x) else f"{float(x):.7g}" if abs(x) > 1e-9 else "0"
    return str(x)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_duckdb(spark, duck, name):
    d = registry.QUERIES[name](spark, SF)
    q = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in q.description]
    assert sorted(d.columns) == sorted(columns)
    got, want = rows([tuple(r) for r in d.collect()], d.columns), rows(q.fetchall(), columns)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    d = entry.entry(spark)
    assert d.count() > 0 and d.columns == ["compound", "p_mean", "nm_mean", "n", "spread", "assays"]


def test_names():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
