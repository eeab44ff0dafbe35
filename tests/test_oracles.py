"""Every registered query against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, key):
    text, _, _, ok = compare(spark, con, QUERIES[key], ORACLES.get(key), sf_dir)
    assert ok, text


def test_entry_has_rows(spark):
    assert entry(spark).count() == 10
