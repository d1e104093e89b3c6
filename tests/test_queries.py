"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cardwright.plans import catalog
from tests.same import same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    assert same(catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "n_groups", "n_multi", "n_items_multi", "n_mixed", "purity"]
