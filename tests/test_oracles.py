"""Every query of the catalogue against its SQL twin, and the entry module."""

import os

import duckdb
import pandas as pd
import pytest

from leafmill.plans import catalogue

QUERIES, ORACLES = catalogue.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    if hasattr(x, "item") and not isinstance(x, pd.Timestamp):
        x = x.item()
    return round(x, 9) if isinstance(x, float) else x if isinstance(x, (int, bool)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_operators(tmp_path):
    """The entry module imports and lists the rest when that part is deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("leafmill", "__spark_entry__.py"):
        source = os.path.join(root, part)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "leafmill" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]; assert 'library_folders' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
