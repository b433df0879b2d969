"""Every query with SQL gives what DuckDB gives; the rest works without the training-data folder."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from corpus_ops import registry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(value):
    return ("nan" if math.isnan(value) else round(value, 9)) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    sql = duck.sql(registry.ORACLES[name])
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert sorted(sql.columns) == sorted(df.columns)
    assert got == sorted(str([plain(r[i]) for i in at]) for r in sql.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() >= 0


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_training_data_folder(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for name in ("corpus_ops", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "corpus_ops" / "llm")
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('p1_')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_imports_it():
    root = Path(__file__).resolve().parents[1] / "corpus_ops"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text()
