"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from linkloom.plans import catalogue

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        assert got
        return
    found = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == names
    places = [found.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=str)


def test_without_the_training_subpackage(tmp_path):
    """With its folders and the pipeline deleted the entry still imports, and has the other queries and their SQL."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("linkloom", "__spark_entry__.py"):
        source, target = os.path.join(root, name), tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "error", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
