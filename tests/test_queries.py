"""Every registered query against its SQL at the smallest scale, and the driver contract."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from plantlens.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Model fitting repeats many small jobs; the check tool covers these at every scale.
SLOW = {"M05_families_compared", "M06_grid_search", "M06_successive_halving", "E13_process_series"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(autouse=True)
def small_blocks():
    """Use the real block length here."""


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in oracle_sql():
        cur = duck.execute(oracle_sql()[name])
        assert got == _canonical([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[1]


def test_entry_has_a_stable_schema(spark):
    assert entry(spark).schema == entry(spark).schema


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
