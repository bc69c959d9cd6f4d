"""Written tables that cut lineage, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_all: list[list[tuple[SparkSession, str]]] = []


class _Scopes(threading.local):
    """Each thread has scopes of its own, so that queries in threads never remove each other's tables."""

    def __init__(self) -> None:
        self.open: list[list[tuple[SparkSession, str]]] = [[]]
        _all.append(self.open[0])


_scopes = _Scopes()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def folder(spark: SparkSession) -> str:
    """A new folder for a job's output and checkpoint, below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"


def _save(df: DataFrame, partition_by: tuple[str, ...] = ()) -> tuple[SparkSession, str]:
    place = df.sparkSession, f"{checkpoint_root(df.sparkSession)}/tracewright/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(place[1])
    return place


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it again, so later failures do not recompute it."""
    place = _save(df, partition_by)
    _scopes.open[-1].append(place)
    return place[0].read.schema(df.schema).parquet(place[1])


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: never sent whole through the driver, however small its file looks."""
    return df.hint("merge")


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns and remove the tables that were written on the way to it."""
    _scopes.open.append([])
    try:
        df = make()
        place = _save(df)
    finally:
        _remove(_scopes.open.pop())
    _scopes.open[-1].append(place)
    return place[0].read.schema(df.schema).parquet(place[1])


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            remove_path(spark, path)
        except Exception:  # a table that cannot be removed now goes with the cluster's folder
            continue


@atexit.register
def _remove_all() -> None:
    for tables in _all:
        _remove(tables)
