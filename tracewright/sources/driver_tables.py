"""Views of the driver's tables as the engine's facts: sightings, segments, devices, turns, vectors and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.timeq import HOUR, SECOND, nanos


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, subject, device, start_ns, end_ns, value``: events last as many seconds as their value's whole part."""
    start = nanos(F.col("ts"))
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("device"), start.alias("start_ns"),
        (start + F.col("value").cast("long") * SECOND).alias("end_ns"), "value", "props",
    )


SIGHTINGS_SQL = """s AS (SELECT event_id, user_id AS subject, event_type AS device, epoch_us(ts) * 1000 AS start_ns,
  epoch_us(ts) * 1000 + CAST(trunc(value) AS BIGINT) * 1000000000 AS end_ns, value, props FROM events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session, sequence, device, start_ns, duration_ns, bytes, media_type``: media types are 1 to 3."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), F.col("l_linenumber").cast("long").alias("sequence"), F.col("l_suppkey").alias("device"),
        nanos(F.col("l_shipdate")).alias("start_ns"), (F.col("l_quantity").cast("long") * HOUR).alias("duration_ns"),
        F.col("l_extendedprice").cast("long").alias("bytes"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("media_type"), F.col("l_partkey").alias("part"),
    )


SEGMENTS_SQL = """g AS (SELECT l_orderkey AS session, CAST(l_linenumber AS BIGINT) AS sequence, l_suppkey AS device, epoch_us(l_shipdate) * 1000 AS start_ns,
  CAST(trunc(l_quantity) AS BIGINT) * 3600000000000 AS duration_ns, CAST(trunc(l_extendedprice) AS BIGINT) AS bytes,
  CAST(l_linenumber % 3 + 1 AS INTEGER) AS media_type, l_partkey AS part FROM lineitem)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, speaker, text, start_ns, end_ns``: ten seconds a turn and three of silence after every fourth."""
    start = (F.col("turn") * 10 + F.expr("turn div 4") * 3) * SECOND
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text", start.alias("start_ns"), (start + 10 * SECOND).alias("end_ns"))


TURNS_SQL = """t AS (SELECT conv_id, turn, role AS speaker, text, (turn * 10 + (turn // 4) * 3) * 1000000000 AS start_ns,
  (turn * 10 + (turn // 4) * 3) * 1000000000 + 10000000000 AS end_ns FROM conversations)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding, identity``: every seventh vector is not attributed to anyone."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 != 0, F.col("label")).alias("identity"))


VECTORS_SQL = "v AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 <> 0 THEN label END AS identity FROM embeddings)"
