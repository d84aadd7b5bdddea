"""Every registered query against its own SQL on the small tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from pagelake import catalog
from tools.check import rows_of

QUERIES, CHECKS = catalog.queries(), catalog.checks()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_checks_belong_to_queries():
    assert CHECKS.keys() <= QUERIES.keys()


def test_queries_are_listed_without_a_session():
    """In a process of its own: the tests' session would hide what needs one."""
    say = "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", say], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-800:]
    assert QUERIES.keys() < set(said.stdout.split())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in CHECKS:
        assert got or name in ("median_cut",)
        return
    cur = con.execute(CHECKS[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, want)
