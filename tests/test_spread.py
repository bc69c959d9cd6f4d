"""Large tables are dealt into as many parts as they need, with the same rows in the end."""

import pytest

from tests.oracle import assert_same
from tracewright.catalog import ORACLE_SQL, QUERIES
from tracewright.operators import folds

SF = "/root/testdata/sf0.001"


def test_parts_grow_with_the_rows(spark):
    rows, usual = spark.range(1_000), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert folds.spread(rows, "id", most=1_000).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert folds.spread(rows, "id", n=100 * usual, most=10).rdd.getNumPartitions() == 10 * usual


@pytest.mark.parametrize("name", ["device_rollup", "timeline", "status_runs"])
def test_same_rows_from_many_parts(spark, monkeypatch, name):
    monkeypatch.setattr(folds, "ROWS", 150)
    df = QUERIES[name](spark, SF)
    assert "Exchange hashpartitioning" in (plan := df._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan
    assert_same(df, ORACLE_SQL[name], SF)


def test_digests_are_shuffled_as_bytes(spark):
    plan = QUERIES["segment_ingest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(sha2(" in plan
