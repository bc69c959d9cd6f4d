"""Footage: segments by device and day, ingest verdicts, clean-up, and the state of processing lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.timeq import DAY, HOUR, civil_day
from tracewright.operators.folds import spread
from tracewright.operators.intervals import clamped
from tracewright.operators.timelines import status_intervals, timeline_spans
from tracewright.registry import query
from tracewright.sources.driver_tables import SEGMENTS_SQL, read, segments

LO, HI = 9_500 * DAY, 9_900 * DAY
#: Only the newest segments still refer to their parts.
RECENT = 11_600 * DAY
_MEDIA = "CASE media_type WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'muxed' ELSE 'other' END"


def end_ns():
    return F.col("start_ns") + F.col("duration_ns")


def within(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Half-open overlap with ``[lo, hi)``. The bound on the raw start is implied, but lets the scan skip row groups."""
    return df.where((F.col("start_ns") < hi) & (end_ns() > lo))


@query(
    "footage_totals",
    f"""WITH {SEGMENTS_SQL}, c AS (SELECT *, least(start_ns + duration_ns, {HI}) - greatest(start_ns, {LO}) AS clamp FROM g WHERE start_ns < {HI} AND start_ns + duration_ns > {LO})
SELECT device, CAST(coalesce(sum(clamp) FILTER (WHERE media_type IN (2, 3)), 0) AS BIGINT) AS video_ns, CAST(coalesce(sum(clamp) FILTER (WHERE media_type IN (1, 3)), 0) AS BIGINT) AS audio_ns,
  count(*) AS n, min(start_ns) AS first_ns, max(start_ns + duration_ns) AS last_ns FROM c GROUP BY device""",
)
def footage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = clamped(F.col("start_ns"), end_ns(), LO, HI)
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("media_type").isin(*kinds), part)), F.lit(0))
    return within(segments(spark, sf_dir), LO, HI).groupBy("device").agg(of(2, 3).alias("video_ns"), of(1, 3).alias("audio_ns"), F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("first_ns"), F.max(end_ns()).alias("last_ns"))


@query(
    "device_rollup",
    f"""WITH {SEGMENTS_SQL} SELECT s_suppkey AS device, count(session) AS segments, count(DISTINCT session) AS sessions, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes,
  min(start_ns) AS first_ns, max(start_ns) AS last_ns, coalesce(bool_or(media_type IN (1, 3)), false) AS has_audio, coalesce(bool_or(media_type IN (2, 3)), false) AS has_video
FROM supplier LEFT JOIN g ON s_suppkey = device GROUP BY s_suppkey""",
)
def device_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices without a segment appear with zeros. Segments are counted by session, then by device, before they meet the devices."""
    devices = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device"))
    of = lambda *kinds: F.bool_or(F.col("media_type").isin(*kinds))
    g = segments(spark, sf_dir)
    by_session = spread(g.select("device", "session", "bytes", "start_ns", "media_type"), "device", "session").groupBy("device", "session").agg(
        F.count("session").alias("segments"), F.sum("bytes").alias("bytes"), F.min("start_ns").alias("first_ns"), F.max("start_ns").alias("last_ns"), of(1, 3).alias("has_audio"), of(2, 3).alias("has_video"),
    )
    by_device = by_session.groupBy("device").agg(
        F.sum("segments").alias("segments"), F.count("session").alias("sessions"), F.sum("bytes").alias("bytes"),
        F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.bool_or("has_audio").alias("has_audio"), F.bool_or("has_video").alias("has_video"),
    )
    none = {"segments": F.lit(0), "sessions": F.lit(0), "bytes": F.lit(0), "has_audio": F.lit(False), "has_video": F.lit(False)}
    return devices.dropDuplicates().join(by_device, "device", "left").withColumns({c: F.coalesce(c, zero) for c, zero in none.items()})


@query(
    "device_daily_usage",
    f"""WITH {SEGMENTS_SQL} SELECT device, CAST(timezone('America/New_York', timezone('UTC', make_timestamp(start_ns // 1000))) AS DATE) AS day, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes,
  min(start_ns) AS first_ns, max(start_ns + duration_ns) AS last_ns FROM g GROUP BY ALL""",
)
def device_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are civil days of the named time zone."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.expr("start_ns div 1000")), "America/New_York"))
    return segments(spark, sf_dir).groupBy("device", day.alias("day")).agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"), F.min("start_ns").alias("first_ns"), F.max(end_ns()).alias("last_ns"))


@query("windowed_segments", f"WITH {SEGMENTS_SQL} SELECT device, session, sequence, start_ns, duration_ns, {_MEDIA} AS kind FROM g WHERE start_ns < {LO + 30 * DAY} AND start_ns + duration_ns > {LO}")
def windowed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("media_type") == 1, "audio").when(F.col("media_type") == 2, "video").when(F.col("media_type") == 3, "muxed").otherwise("other")
    return within(segments(spark, sf_dir), LO, LO + 30 * DAY).select("device", "session", "sequence", "start_ns", "duration_ns", kind.alias("kind"))


@query("window_has_footage", f"WITH {SEGMENTS_SQL} SELECT EXISTS (SELECT 1 FROM g WHERE start_ns < {HI} AND start_ns + duration_ns > {LO}) AS has_footage")
def window_has_footage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(segments(spark, sf_dir), LO, HI).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_footage"))


@query(
    "overlap_clamp",
    f"WITH {SEGMENTS_SQL} SELECT session, sequence, greatest(least(start_ns + duration_ns, {HI}) - greatest(start_ns, {LO}), 0) AS part_ns FROM g",
)
def overlap_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("session", "sequence", clamped(F.col("start_ns"), end_ns(), LO, HI).alias("part_ns"))


def ingest_verdicts(manifests: DataFrame, key: str, sha: str, place: list[str], arrival: list[str]) -> DataFrame:
    """Each manifest's verdict in the order of arrival: ``inserted``, ``duplicate`` (same key and bytes as the first of
    the key), ``conflict`` (same key, other bytes) or ``sequence_conflict`` (another key holds its place)."""
    by_key, by_place = W.partitionBy(key).orderBy(*arrival), W.partitionBy(*place).orderBy(*arrival)
    first = F.row_number().over(by_key) == 1
    same = F.first(sha).over(by_key) == F.col(sha)
    taken = F.first(key).over(by_place) != F.col(key)
    return manifests.withColumn("verdict", F.when(~first & same, "duplicate").when(~first, "conflict").when(taken, "sequence_conflict").otherwise("inserted"))


@query(
    "segment_ingest",
    f"""WITH {SEGMENTS_SQL}, m AS (SELECT concat(session, '-', sequence) AS id, sha256(concat(part, '|', bytes)) AS sha, part, sequence, start_ns, 0 AS arrival, media_type FROM g
  UNION ALL SELECT concat(session, '-', sequence), sha256(concat(part, '|', bytes + CAST(sequence = 2 AS BIGINT))), part, sequence, start_ns, 1, media_type FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival, start_ns, id, sha) AS k, first_value(sha) OVER (PARTITION BY id ORDER BY arrival, start_ns, id, sha) AS sha1,
  first_value(id) OVER (PARTITION BY part, sequence ORDER BY arrival, start_ns, id, sha) AS id1 FROM m),
d AS (SELECT *, CASE WHEN k > 1 AND sha = sha1 THEN 'duplicate' WHEN k > 1 THEN 'conflict' WHEN id1 <> id THEN 'sequence_conflict' ELSE 'inserted' END AS verdict FROM r)
SELECT verdict, count(*) AS n, count(*) FILTER (WHERE verdict = 'inserted' AND media_type IN (1, 3)) AS audio_lane, count(*) FILTER (WHERE verdict = 'inserted' AND media_type IN (2, 3)) AS vision_lane FROM d GROUP BY verdict""",
)
def segment_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment arrives twice, the second of a session with other bytes; accepted ones enter their lanes.

    Digests go through both shuffles, as bytes, which have the order of their hexadecimal texts at half the length."""
    g = segments(spark, sf_dir).withColumn("id", F.concat_ws("-", "session", "sequence"))
    sha = lambda extra: F.unhex(F.sha2(F.concat_ws("|", "part", F.col("bytes") + extra), 256))
    twice = g.withColumns({"sha": sha(0), "arrival": F.lit(0)}).unionByName(g.withColumns({"sha": sha((F.col("sequence") == 2).cast("long")), "arrival": F.lit(1)}))
    told = ingest_verdicts(twice, "id", "sha", ["part", "sequence"], ["arrival", "start_ns", "id", "sha"])
    lane = lambda *kinds: F.count_if((F.col("verdict") == "inserted") & F.col("media_type").isin(*kinds))
    return told.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), lane(1, 3).alias("audio_lane"), lane(2, 3).alias("vision_lane"))


@query(
    "blob_store",
    f"""WITH {SEGMENTS_SQL}, b AS (SELECT DISTINCT sha256(CAST(bytes AS VARCHAR)) AS sha, bytes FROM g)
SELECT sha, 'blobs/' || substr(sha, 1, 2) || '/' || substr(sha, 3, 2) || '/' || sha AS blob_uri, bytes FROM b""",
)
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical content is stored once, under a path that its digest gives."""
    b = segments(spark, sf_dir).select(F.sha2(F.col("bytes").cast("string"), 256).alias("sha"), "bytes").dropDuplicates(["sha"])
    return b.withColumn("blob_uri", F.concat(F.lit("blobs/"), F.substring("sha", 1, 2), F.lit("/"), F.substring("sha", 3, 2), F.lit("/"), F.col("sha")))


@query("blob_garbage", f"WITH {SEGMENTS_SQL} SELECT p_partkey AS part, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.part = p_partkey AND start_ns >= {RECENT})")
def blob_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no live segment refers to."""
    live = segments(spark, sf_dir).where(F.col("start_ns") >= RECENT).select("part")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name").join(live, "part", "left_anti")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "error").otherwise("pending")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), F.col("o_custkey").alias("customer"), status.alias("status"), F.col("o_orderkey").alias("order_no"), (F.col("o_orderkey") % 5).alias("attempts"), F.col("o_orderdate").alias("updated"))


_ORDERS_SQL = "o AS (SELECT o_orderkey AS segment, o_custkey AS customer, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'error' ELSE 'pending' END AS status, o_orderkey % 5 AS attempts, o_orderdate AS updated FROM orders)"


@query("queue_claim", f"WITH {_ORDERS_SQL} SELECT segment, status, attempts FROM o WHERE status = 'pending' OR (status = 'error' AND attempts < 3) ORDER BY updated, segment LIMIT 100")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest hundred that may be worked on."""
    free = (F.col("status") == "pending") | ((F.col("status") == "error") & (F.col("attempts") < 3))
    return _orders(spark, sf_dir).where(free).orderBy("updated", "segment").limit(100).select("segment", "status", "attempts")


@query(
    "queue_statistics",
    f"""WITH {_ORDERS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'error') AS error,
  count(*) FILTER (WHERE status = 'error' AND attempts >= 3) AS dead, epoch(max(updated) - min(updated) FILTER (WHERE status = 'pending')) AS oldest_pending_s FROM o""",
)
def queue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    age = F.unix_micros(F.max(F.col("updated").cast("timestamp"))) - F.unix_micros(F.min(F.when(is_("pending"), F.col("updated").cast("timestamp"))))
    return _orders(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_("pending")).alias("pending"), F.count_if(is_("done")).alias("done"), F.count_if(is_("error")).alias("error"),
        F.count_if(is_("error") & (F.col("attempts") >= 3)).alias("dead"), (age / 1_000_000).alias("oldest_pending_s"),
    )


@query("lane_backfill", f"WITH {SEGMENTS_SQL}, {_ORDERS_SQL} SELECT session, sequence, 'pending' AS status FROM g WHERE media_type IN (1, 3) AND NOT EXISTS (SELECT 1 FROM o WHERE segment = session AND status <> 'pending')")
def lane_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio segments that have no status row yet."""
    known = _orders(spark, sf_dir).where("status <> 'pending'").select(F.col("segment").alias("session"))
    return segments(spark, sf_dir).where(F.col("media_type").isin(1, 3)).join(known, "session", "left_anti").select("session", "sequence", F.lit("pending").alias("status"))


@query("lane_summary", f"WITH {SEGMENTS_SQL}, {_ORDERS_SQL} SELECT device, coalesce(CASE WHEN customer % 3 > 0 THEN status END, 'pending') AS status, count(*) AS n FROM g LEFT JOIN o ON session = segment GROUP BY ALL")
def lane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing status counts as pending."""
    o = _orders(spark, sf_dir).select(F.col("segment").alias("session"), F.when(F.col("customer") % 3 > 0, F.col("status")).alias("status"))
    return segments(spark, sf_dir).join(o, "session", "left").groupBy("device", F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "segment_outputs",
    f"""WITH {SEGMENTS_SQL} SELECT device, start_ns // {DAY} AS day, count(*) AS n, count(DISTINCT part) AS parts, array_to_string(list_sort(list_distinct(list(media_type))), ',') AS kinds FROM g GROUP BY ALL""",
)
def segment_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.transform(F.array_sort(F.collect_set("media_type")), lambda x: x.cast("string")), ",")
    return segments(spark, sf_dir).groupBy("device", civil_day(F.col("start_ns")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"), kinds.alias("kinds"))


@query(
    "retention_sweep",
    f"""WITH {SEGMENTS_SQL}, old AS (SELECT * FROM g WHERE start_ns + duration_ns <= {LO}), live AS (SELECT DISTINCT bytes FROM g WHERE start_ns + duration_ns > {LO})
SELECT device, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT bytes) FILTER (WHERE bytes NOT IN (SELECT bytes FROM live)) AS freed_blobs FROM old GROUP BY device""",
)
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only segments that lie wholly before the cut go; a blob is freed when nothing that stays refers to it."""
    g = segments(spark, sf_dir)
    live = g.where(end_ns() > LO).select("bytes").distinct().withColumn("live", F.lit(True))
    old = g.where(end_ns() <= LO).join(live, "bytes", "left")
    return old.groupBy("device").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"), F.countDistinct(F.when(F.col("live").isNull(), F.col("bytes"))).alias("freed_blobs"))


@query(
    "playlist_breaks",
    f"""WITH {SEGMENTS_SQL}, l AS (SELECT *, lag(start_ns + duration_ns) OVER (PARTITION BY device ORDER BY session, sequence, start_ns, part, bytes) AS pe, lag(session) OVER (PARTITION BY device ORDER BY session, sequence, start_ns, part, bytes) AS ps FROM g)
SELECT device, session, sequence, (ps IS NULL OR ps <> session OR abs(start_ns - pe) > 300000000) AS discontinuity FROM l""",
)
def playlist_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A playlist is interrupted at another session or more than 300 ms away from the end before."""
    w = W.partitionBy("device").orderBy("session", "sequence", "start_ns", "part", "bytes")
    broken = F.lag("session").over(w).isNull() | (F.lag("session").over(w) != F.col("session")) | (F.abs(F.col("start_ns") - F.lag(end_ns()).over(w)) > 300_000_000)
    return segments(spark, sf_dir).select("device", "session", "sequence", broken.alias("discontinuity"))


@query(
    "speaker_window",
    f"""WITH {SEGMENTS_SQL}, d AS (SELECT *, dense_rank() OVER (PARTITION BY session ORDER BY sequence) AS place FROM g), e AS (SELECT *, sequence - place AS isle FROM d),
r AS (SELECT session, sequence, count(*) OVER w AS reach, sum(duration_ns) OVER w AS total FROM e WINDOW w AS (PARTITION BY session, isle ORDER BY sequence, start_ns, part, bytes ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT session, sequence, reach, CAST(total AS BIGINT) AS total_ns FROM r""",
)
def speaker_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment and up to three right before it, as far back as sequence numbers follow one another."""
    g = segments(spark, sf_dir).withColumn("isle", F.col("sequence") - F.dense_rank().over(W.partitionBy("session").orderBy("sequence")))
    w = W.partitionBy("session", "isle").orderBy("sequence", "start_ns", "part", "bytes").rowsBetween(-3, 0)
    return g.select("session", "sequence", F.count(F.lit(1)).over(w).alias("reach"), F.sum("duration_ns").over(w).alias("total_ns"))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's segments of a media type as one stream, in the order of their starts."""
    place = F.row_number().over(W.partitionBy("device", "media_type").orderBy("start_ns", "session", "sequence", "part", "bytes"))
    return spread(segments(spark, sf_dir), "device", "media_type").withColumn("place", place)


#: The fold of each stream's rows in order: a row goes on with the span before, or begins one, numbered by its place.
_FOLD = """p AS (SELECT *, row_number() OVER (PARTITION BY device, media_type ORDER BY start_ns, session, sequence, part, bytes) AS place FROM g),
q AS (SELECT {columns}),
f AS (SELECT *, start_ns + duration_ns AS reach, place AS span FROM q WHERE place = (SELECT min(place) FROM q AS o WHERE o.device = q.device AND o.media_type = q.media_type)
  UNION ALL SELECT n.*, CASE WHEN ({breaks}) OR abs(n.start_ns - f.reach) > n.duration_ns THEN n.start_ns + n.duration_ns ELSE greatest(f.reach, n.start_ns + n.duration_ns) END,
  CASE WHEN ({breaks}) OR abs(n.start_ns - f.reach) > n.duration_ns THEN n.place ELSE f.span END FROM f JOIN q AS n ON n.device = f.device AND n.media_type = f.media_type AND n.place = f.place + 1)"""


@query(
    "timeline",
    f"""WITH RECURSIVE {SEGMENTS_SQL}, {_FOLD.format(columns="device, media_type, place, start_ns, duration_ns, session % 4 = 0 AS gap FROM p", breaks="n.gap")}
SELECT media_type AS stream, device AS session, arg_min(start_ns, place) AS start_ns, max(start_ns + duration_ns) AS end_ns, count(*) AS segments FROM f GROUP BY media_type, device, span""",
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_spans(_streams(spark, sf_dir).withColumn("gap_before", F.col("session") % 4 == 0), "media_type", "device", "place")


@query(
    "status_runs",
    f"""WITH RECURSIVE {SEGMENTS_SQL}, {_ORDERS_SQL}, {_FOLD.format(columns="device, media_type, row_number() OVER (PARTITION BY device, media_type ORDER BY place) AS place, start_ns, duration_ns, status, CASE WHEN status = 'error' THEN concat('e', attempts) END AS err FROM p JOIN o ON o.segment = p.session", breaks="n.status IS DISTINCT FROM f.status")}
SELECT media_type AS stream, device AS session, arg_min(start_ns, place) AS start_ns, max(start_ns + duration_ns) AS end_ns, count(*) AS segments, arg_min(status, place) AS status, arg_max(err, place) FILTER (WHERE err IS NOT NULL) AS last_error FROM f GROUP BY media_type, device, span""",
)
def status_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.col("segment").alias("session"), "status", F.when(F.col("status") == "error", F.concat(F.lit("e"), F.col("attempts"))).alias("last_error"))
    n = segments(spark, sf_dir).count()
    g = spread(_streams(spark, sf_dir), "session", n=n).join(o, "session").withColumn("gap_before", F.lit(False))
    return status_intervals(spread(g, "media_type", "device", n=n), "media_type", "device", "place")


@query("empty_devices", "SELECT c_custkey AS device FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def empty_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device")).join(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("device")), "device", "left_anti")
