"""Every registered query: rows equal to its SQL's, or at least rows that can be had."""

import pytest

from tests.oracle import assert_same
from tracewright.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        assert_same(df, ORACLE_SQL[name], SF)
    else:
        df.collect()
