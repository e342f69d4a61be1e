"""Every query with SQL against DuckDB over the same tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import importlib

from tests.conftest import SF

CORE = ["pipeline", "kv", "replicas", "raftlog", "extra"]
MODULES = [importlib.import_module(f"tidelog.plans.{m}") for m in CORE]
CASES = [(name, m) for m in MODULES for name in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def key(row):
    return repr(tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))


@pytest.mark.parametrize("name,module", CASES, ids=[n for n, _ in CASES])
def test_query(spark, db, name, module):
    df = module.QUERIES[name](spark, SF)
    got = sorted(key(r) for r in df.collect())
    if name not in module.SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    rel = db.sql(module.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert got == sorted(key([r[i] for i in at]) for r in rel.fetchall())


def test_entry_lists_every_core_query(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert {n for n, _ in CASES} <= set(names)
    assert set(e.oracle_sql()) <= set(names)
    assert e.entry(spark).count() > 0
