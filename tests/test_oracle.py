"""Every registered query against its SQL at the smallest scale."""
import os

import pytest

import __spark_entry__ as entry
from jobweave.checks.compare import difference, oracle_rows
from jobweave.checks.registry import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    columns, expected = oracle_rows(SF_DIR, ORACLE[name])
    assert difference(df.columns, rows, columns, expected) == ""
    assert rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).columns == ["profile_id", "pos", "url", "source", "title", "required_text"]
