"""All registered queries against their SQL, and without the corpus folders."""

import datetime
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from talkprism import queries as library

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(v, 6) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    sql = duck.sql(library.SQL[name])
    assert sorted(sql.columns) == columns
    theirs = sorted([tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall()], key=str)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_folders(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "talkprism"):
        (shutil.copytree if os.path.isdir(f"{here}/{name}") else shutil.copy)(f"{here}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "talkprism/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
