"""Every registered query with an oracle matches DuckDB on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(E.queries()[name](spark, SF), ORACLE[name], SF)
    assert ok, msg


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "fair_score" in df.columns
