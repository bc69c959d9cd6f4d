"""Incremental passes as Structured Streaming jobs over a growing folder of event files.

Offsets and state live in the checkpoint of each job, which takes the place of hand-kept watermarks; run with
``availableNow`` a job drains what has arrived and stops. Each has a batch twin with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.functions.timeq import SECOND, floor_div, nanos
from tracewright.plans.attachments import LATE_SQL, attached, late_rows
from tracewright.operators.scratch import folder
from tracewright.registry import query
from tracewright.sources.driver_tables import SIGHTINGS_SQL

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
BUCKET, COOLDOWN = 30 * SECOND, 3600 * SECOND


def arriving(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    parent, _, name = path.rpartition("/")
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(parent)
    start = nanos(F.col("ts"))
    return s.select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("device"), F.col("ts").cast("timestamp").alias("at"), start.alias("start_ns"), (start + F.col("value").cast("long") * SECOND).alias("end_ns"), "value")


def drained(stream: DataFrame, spark: SparkSession, mode: str, write: Callable[[DataFrame, int, str], None]) -> DataFrame:
    """Run until all that has arrived is done; ``write(batch, number, path)`` must be idempotent by batch number."""
    place = folder(spark)
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(lambda df, n: write(df, n, f"{place}/out")).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{place}/out")


def replace(batch: DataFrame, number: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


def add(batch: DataFrame, number: int, path: str) -> None:
    """Each batch has a folder of its own, so a batch that is run again replaces what it wrote."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that batches have updated, each key's newest; the number of a batch is its folder's."""
    return written.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in written.columns if c not in (*keys, "batch"))), "batch").alias("r")).select(*keys, "r.*")


@query("stream_bucket_sessions", f"WITH {SIGHTINGS_SQL} SELECT subject, device, start_ns // {BUCKET} AS bucket, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n FROM s GROUP BY ALL")
def stream_bucket_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling buckets folded as events arrive. Only buckets that changed are written again, and those that the
    watermark of an hour has passed leave the state."""
    s = arriving(spark, f"{sf_dir}/events.parquet").withWatermark("at", "1 hour")
    folded = s.groupBy("subject", "device", F.window("at", f"{BUCKET // SECOND} seconds").alias("w")).agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("n"))
    bucket = floor_div(F.unix_micros("w.start") * 1000, BUCKET)
    return latest(drained(folded.select("subject", "device", bucket.alias("bucket"), "start_ns", "end_ns", "n"), spark, "update", add), ["subject", "device", "bucket"])


@query("stream_subject_marks", f"WITH {SIGHTINGS_SQL} SELECT subject, count(*) AS events, max(start_ns) AS last_ns FROM s GROUP BY subject")
def stream_subject_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's own mark: how much of it is folded and up to when; one small state a subject, which stays."""
    s = arriving(spark, f"{sf_dir}/events.parquet")
    return latest(drained(s.groupBy("subject").agg(F.count(F.lit(1)).alias("events"), F.max("start_ns").alias("last_ns")), spark, "update", add), ["subject"])


@query(
    "stream_closed_days",
    f"WITH {SIGHTINGS_SQL}, m AS (SELECT max(start_ns) - 90000000000 AS mark FROM s) SELECT device, start_ns // 86400000000000 AS day, count(*) AS n, max(end_ns) AS end_ns FROM s, m WHERE (start_ns // 86400000000000 + 1) * 86400000000000 <= mark GROUP BY ALL",
)
def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each device, told once they are over by the grace of 90 seconds; the open day waits for the next run."""
    s = arriving(spark, f"{sf_dir}/events.parquet").withWatermark("at", "90 seconds")
    days = s.groupBy("device", F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("end_ns").alias("end_ns"))
    day = floor_div(F.unix_micros("w.start") * 1000, 86_400 * SECOND)
    return drained(days.select("device", day.alias("day"), "n", "end_ns"), spark, "append", add).drop("batch")


@query("stream_late_attach", LATE_SQL)
def stream_late_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows of a stream against spans that are closed and do not change: each batch is attached on its own."""
    _, spans = late_rows(spark, sf_dir)
    late = arriving(spark, f"{sf_dir}/events.parquet").where("event_id % 5 = 0").select("event_id", "device", "start_ns")
    return drained(late, spark, "append", lambda batch, n, path: add(attached(batch, spans), n, path)).drop("batch")


@query("stream_ingest", f"WITH {SIGHTINGS_SQL} SELECT DISTINCT event_id, subject, device, start_ns FROM s")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, however often it is delivered (here twice), as long as it comes within the watermark."""
    s = arriving(spark, f"{sf_dir}/events.parquet").unionByName(arriving(spark, f"{sf_dir}/events.parquet"))
    once = s.withWatermark("at", "90 days").dropDuplicatesWithinWatermark(["event_id"])
    return drained(once.select("event_id", "subject", "device", "start_ns"), spark, "append", add).drop("batch")


def _cooled(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    sent = []
    for r in pd.concat(list(batches)).sort_values(["start_ns", "event_id"]).itertuples(index=False):
        if last is None or r.start_ns - last >= COOLDOWN:
            sent.append((key[0], r.event_id, r.start_ns))
            last = r.start_ns
    if last is not None:
        state.update((int(last),))
    yield pd.DataFrame(sent, columns=["subject", "event_id", "start_ns"])


@query("stream_cooldown")
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a subject at most once an hour: the last delivery is the state of each subject."""
    s = arriving(spark, f"{sf_dir}/events.parquet").select("subject", "event_id", "start_ns")
    told = s.groupBy("subject").applyInPandasWithState(_cooled, "subject long, event_id long, start_ns long", "last long", "append", GroupStateTimeout.NoTimeout)
    return drained(told, spark, "append", add).drop("batch")


@query("stream_sessions")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each subject that six hours of silence and the watermark have closed; later events start new ones.

    A session that the watermark has not closed is no row yet: it stays in the state for the next run."""
    s = arriving(spark, f"{sf_dir}/events.parquet").withWatermark("at", "90 seconds")
    closed = s.groupBy("subject", F.session_window("at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("start_ns"), F.max("start_ns").alias("end_ns"))
    return drained(closed.drop("w"), spark, "append", add).drop("batch")
