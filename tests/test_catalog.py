"""Every query of the library runs; those with SQL give the same rows as DuckDB."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from millrace import catalog
from tests.oracle import assert_same, duck

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, sf_dir, con):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.SQL:
        assert_same(got, con.execute(catalog.SQL[name]).df())
    else:
        assert len(got)


def test_queries_without_sql_are_reproducible(spark, sf_dir):
    for name in ("chunk_recursive", "magpie_mock", "reject_sampling_mock"):
        a, b = (catalog.QUERIES[name](spark, sf_dir).toPandas() for _ in range(2))
        assert_same(a, b)


def test_entry_has_a_stable_schema(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "hash_id", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    for x in ("__spark_entry__.py", "millrace"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    shutil.rmtree(tmp_path / "millrace/llm", ignore_errors=True)
    got = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert got.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "millrace").parts:
            assert "millrace.llm" not in p.read_text(), p
