"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators.graphs import components
from tracewright.operators.scratch import checkpoint_root, settled, written

__all__ = ["checkpoint_root", "components", "settled", "table", "tasks_for", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, nbytes: int, per_task: int = 32 << 20) -> int:
    """Partitions so that each holds about ``per_task`` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // per_task))
