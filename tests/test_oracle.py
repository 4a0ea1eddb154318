"""Every registered query with a DuckDB twin gives the same rows; the others give rows."""

import pytest

from __spark_entry__ import oracle_sql, queries

from .compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()
# whole-corpus jobs take minutes; tests/test_corpus.py holds them against small pages instead
SLOW = {"clean_corpus", "clean_corpus_kinds", "assess_corpus", "census_corpus", "copy_groups", "segment_sheet"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches(spark, con, key):
    why, _ = difference(QUERIES[key](spark, SF), con, SQL[key])
    assert why is None, why


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_rows_only(spark, key):
    assert QUERIES[key](spark, SF).count() > 0
