"""Every core query against its SQL on the driver's smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from framelake.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(ROOT / "scripts"))


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for path in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    from compare import compare

    if name in ORACLES:
        assert compare(spark, connection, name, QUERIES[name], ORACLES[name], str(SF)) == "ok"
    else:
        assert QUERIES[name](spark, str(SF)).count() > 0


def test_entry_without_the_llm_subpackage(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "framelake.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
