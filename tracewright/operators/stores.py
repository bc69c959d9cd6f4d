"""Stored tables that are written more than once: months as folders, rows replaced by key, and blobs named by their content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.scratch import remove_path, written

MONTH = "month"


def month_of(ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("long")), "yyyy-MM")


def with_month(rows: DataFrame, at: str = "start_ns") -> DataFrame:
    return rows.withColumn(MONTH, month_of(F.col(at)))


def write_months(rows: DataFrame, path: str) -> None:
    """Write ``rows`` with their ``month`` as one folder a month; months that they name are replaced, others stay."""
    spread = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]  # so that no month is one task
    rows.repartition(MONTH, F.pmod(F.xxhash64(*spread), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows. The month is read as text, whatever it looks like."""
    return spark.read.schema(T.StructType([f for f in schema.fields if f.name != MONTH] + [T.StructField(MONTH, T.StringType())])).parquet(path)


def months_of(spark: SparkSession, path: str) -> list[str]:
    """The months that have a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    return sorted(s.getPath().getName().removeprefix(f"{MONTH}=") for s in store.listStatus(place) if s.getPath().getName().startswith(f"{MONTH}="))


def drop_months(spark: SparkSession, path: str, before: str) -> list[str]:
    """Delete the folders of months before ``before`` (as 2024-05), and tell which; no row is read."""
    gone = [m for m in months_of(spark, path) if m < before]
    for m in gone:
        remove_path(spark, f"{path}/{MONTH}={m}")
    return gone


def replace_keys(rows: DataFrame, path: str, key: str) -> None:
    """Replace all stored rows of the keys of ``rows`` (with their ``month``); writing the same rows again changes nothing.

    Only months that hold such a key before or after are written, from a copy that is complete before the first of them
    is touched, so a run that fails may be run again."""
    spark, rows = rows.sparkSession, written(rows)
    if not months_of(spark, path):
        return write_months(rows, path)
    old, keys = read_months(spark, path, rows.schema), rows.select(key).distinct()
    touched = [r[0] for r in old.join(keys, key, "left_semi").select(MONTH).unionByName(rows.select(MONTH)).distinct().collect()]  # months, not rows
    made = written(old.where(F.col(MONTH).isin(touched)).join(keys, key, "left_anti").unionByName(rows))
    write_months(made, path)
    left = {r[0] for r in made.select(MONTH).distinct().collect()}
    for m in set(touched) - left:
        remove_path(spark, f"{path}/{MONTH}={m}")


def replacing(path: str, key: str, at: str = "start_ns") -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch``: batches replace rows by key, so one that is run again changes nothing. Of a key that a
    batch holds more than once all rows stay; they are what the key has now."""
    return lambda batch, number: replace_keys(with_month(batch, at), path, key)


def verdicts(parts: DataFrame, manifests: DataFrame) -> DataFrame:
    """``name, content, sha256, bytes, verdict`` of ``parts(name, content)`` against ``manifests(name, sha256, bytes)``: the length is
    looked at first, then the digest of the whole content."""
    told = manifests.select("name", F.lower("sha256").alias("told_sha"), F.col("bytes").alias("told_bytes"))
    both = parts.join(told, "name", "left").withColumns({"sha256": F.sha2("content", 256), "bytes": F.octet_length("content").cast("long")})
    verdict = F.when(F.col("told_sha").isNull(), "no manifest").when(F.col("content").isNull() | (F.col("bytes") != F.col("told_bytes")), "length").when(F.col("sha256") != F.col("told_sha"), "digest").otherwise("ok")
    return both.select("name", "content", "sha256", "bytes", verdict.alias("verdict"))


BLOBS, NAMES = "sha256 string, bytes long, content binary, shard string", "name string, sha256 string, bytes long, verdict string, at timestamp"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def take_in(parts: DataFrame, manifests: DataFrame, store: str) -> None:
    """Verify ``parts`` and store what is right: each content once, under its digest, and a row for each name and verdict.

    Names that fail have a row with their verdict and no blob. Contents that the store has are not written again, and a
    name's newest verdict replaces what it had; so files that come twice, and runs that are repeated, change nothing."""
    spark = parts.sparkSession
    checked = written(verdicts(parts, manifests))
    good = checked.where("verdict = 'ok'").groupBy("sha256").agg(F.first("bytes").alias("bytes"), F.first("content").alias("content")).withColumn("shard", F.substring("sha256", 1, 2))
    new = good.join(_stored(spark, f"{store}/blobs", BLOBS).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(f"{store}/blobs")
    names = checked.groupBy("name").agg(F.max_by(F.struct("sha256", "bytes", "verdict"), F.col("verdict") == "ok").alias("r")).select("name", "r.*")
    names.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{store}/names")


def taken_in(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """The names with their newest verdicts, and the blobs."""
    names = _stored(spark, f"{store}/names", NAMES).groupBy("name").agg(F.max_by(F.struct("sha256", "bytes", "verdict"), "at").alias("r")).select("name", "r.*")
    return names, _stored(spark, f"{store}/blobs", BLOBS)


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 256) -> DataFrame:
    """A stream of ``name, content`` of the files that are dropped into a folder; Spark passes over files without a byte."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
