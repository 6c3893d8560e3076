"""Every registered query runs on the smallest tables and, where it has SQL, gives the rows that DuckDB gives."""

import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    r = db.execute(catalog.ORACLES[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == columns
    assert got == Counter(tuple(plain(row[at.index(c)]) for c in columns) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_works_without_the_training_data_operators(tmp_path, pipeline_too):
    here = Path(entry.__file__).parent
    for name in ("ledgerline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (here / name).is_dir():
            shutil.copytree(here / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (here / name).exists() and not (pipeline_too and name == "corpus_pipeline.py"):
            shutil.copy(here / name, tmp_path / name)
    code = "import __spark_entry__ as e, ledgerline.catalog as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLES); print(len(c.QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(catalog.QUERIES)
