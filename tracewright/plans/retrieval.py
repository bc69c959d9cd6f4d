"""Listings and lookups: top rows per key, merged samples, set operations and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.registry import query
from tracewright.sources.driver_tables import SEGMENTS_SQL, SIGHTINGS_SQL, read, segments, sightings


@query(
    "latest_sightings",
    f"""WITH {SIGHTINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_ns DESC, event_id) AS k FROM s WHERE value > 50), l AS (SELECT subject, string_agg(event_id || '@' || device, ',' ORDER BY k) AS latest FROM r WHERE k <= 3 GROUP BY subject)
SELECT c_custkey AS subject, coalesce(latest, '') AS latest FROM customer LEFT JOIN l ON subject = c_custkey""",
)
def latest_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest sightings of everyone; those never seen have an empty list."""
    w = W.partitionBy("subject").orderBy(F.desc("start_ns"), "event_id")
    s = sightings(spark, sf_dir).where("value > 50").withColumn("k", F.row_number().over(w)).where("k <= 3")
    line = F.struct("k", F.concat_ws("@", F.col("event_id").cast("string"), "device").alias("x"))
    latest = s.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["x"]), ",").alias("latest"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject")).join(latest, "subject", "left").select("subject", F.coalesce("latest", F.lit("")).alias("latest"))


@query("listing_cut_by_id", f"WITH {SIGHTINGS_SQL}, c AS (SELECT * FROM s WHERE device = 'error' ORDER BY subject, event_id LIMIT 40) SELECT event_id, subject, start_ns FROM c ORDER BY start_ns")
def listing_cut_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit applies in the order of ids, then what is left is sorted by time."""
    return sightings(spark, sf_dir).where("device = 'error'").orderBy("subject", "event_id").limit(40).select("event_id", "subject", "start_ns").orderBy("start_ns")


@query("listing_by_time", f"WITH {SIGHTINGS_SQL} SELECT event_id, device, start_ns FROM s WHERE subject = 2 ORDER BY start_ns, event_id LIMIT 200")
def listing_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of one subject from the first on, up to a limit."""
    return sightings(spark, sf_dir).where("subject = 2").select("event_id", "device", "start_ns").orderBy("start_ns", "event_id").limit(200)


@query(
    "merged_samples",
    f"""WITH {SIGHTINGS_SQL}, e AS (SELECT DISTINCT subject, start_ns, event_id FROM s WHERE event_id % 2 = 0 UNION SELECT DISTINCT subject, start_ns, event_id FROM s WHERE event_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_ns DESC, event_id) AS k FROM e) SELECT subject, string_agg(event_id, ',' ORDER BY k) AS samples FROM r WHERE k <= 5 GROUP BY subject""",
)
def merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of samples of each subject as one: the newest first, none twice, at most five."""
    s, one = sightings(spark, sf_dir), F.struct((-F.col("start_ns")).alias("late"), "event_id")
    kept = lambda rule: s.where(rule).groupBy("subject").agg(F.slice(F.array_sort(F.collect_set(one)), 1, 5).alias("x"))
    a, b = kept("event_id % 2 = 0"), kept("event_id % 3 = 0").withColumnRenamed("x", "y")
    both = a.join(b, "subject", "full").withColumn("all", F.array_sort(F.array_distinct(F.concat(F.coalesce("x", F.slice("y", 1, 0)), F.coalesce("y", F.slice("x", 1, 0))))))
    return both.select("subject", F.array_join(F.transform(F.slice("all", 1, 5), lambda r: r["event_id"].cast("string")), ",").alias("samples"))


@query("nulls_last", f"WITH {SIGHTINGS_SQL}, l AS (SELECT subject, max(start_ns) FILTER (WHERE device = 'purchase') AS last_ns FROM s GROUP BY subject) SELECT * FROM l ORDER BY last_ns DESC NULLS LAST, subject LIMIT 12")
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the last purchase, those without one at the end."""
    last = sightings(spark, sf_dir).groupBy("subject").agg(F.max(F.when(F.col("device") == "purchase", F.col("start_ns"))).alias("last_ns"))
    return last.orderBy(F.desc_nulls_last("last_ns"), "subject").limit(12)


@query(
    "recent_errors",
    f"""WITH {SIGHTINGS_SQL}, e AS (SELECT 'error' AS kind, event_id AS id, start_ns FROM s WHERE device = 'error' ORDER BY start_ns DESC, event_id LIMIT 10), h AS (SELECT 'heartbeat' AS kind, subject AS id, max(start_ns) AS start_ns FROM s GROUP BY subject ORDER BY start_ns DESC, id LIMIT 5) SELECT * FROM e UNION ALL SELECT * FROM h""",
)
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest errors and the newest heartbeats of workers."""
    s = sightings(spark, sf_dir)
    errors = s.where("device = 'error'").orderBy(F.desc("start_ns"), "event_id").limit(10).select(F.lit("error").alias("kind"), F.col("event_id").alias("id"), "start_ns")
    beats = s.groupBy("subject").agg(F.max("start_ns").alias("start_ns")).orderBy(F.desc("start_ns"), "subject").limit(5)
    return errors.unionByName(beats.select(F.lit("heartbeat").alias("kind"), F.col("subject").alias("id"), "start_ns"))


@query("ids_of_lanes", f"WITH {SIGHTINGS_SQL} SELECT subject AS id FROM s WHERE device = 'error' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def ids_of_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).where("device = 'error'").select(F.col("subject").alias("id")).unionByName(read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).distinct()


@query(
    "lane_set_algebra",
    f"WITH {SIGHTINGS_SQL}, a AS (SELECT DISTINCT subject FROM s WHERE device = 'error'), b AS (SELECT DISTINCT subject FROM s WHERE device = 'signup') SELECT 'both' AS kind, subject FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_error', subject FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
)
def lane_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    a, b = (s.where(F.col("device") == d).select("subject") for d in ("error", "signup"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "subject").unionByName(a.subtract(b).select(F.lit("only_error").alias("kind"), "subject"))


@query("names_of_ids", f"WITH {SIGHTINGS_SQL} SELECT event_id, c_name AS name FROM s LEFT JOIN customer ON c_custkey = subject")
def names_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by id; Spark broadcasts the names if they are few."""
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("name"))
    return sightings(spark, sf_dir).join(names, "subject", "left").select("event_id", "name")


@query(
    "enriched_sources",
    f"""WITH {SEGMENTS_SQL}, p AS (SELECT session, list(DISTINCT device ORDER BY device)[1:3] AS persons, list(DISTINCT part ORDER BY part)[1:3] AS objects, list(DISTINCT media_type ORDER BY media_type)[1:2] AS plates FROM g GROUP BY session)
SELECT o_orderkey AS session, 'persons: ' || coalesce(array_to_string(persons, ', '), '') || '; objects: ' || coalesce(array_to_string(objects, ', '), '') || '; plates: ' || coalesce(array_to_string(plates, ', '), '') AS seen FROM orders LEFT JOIN p ON session = o_orderkey""",
)
def enriched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was seen in each source's segment: at most three persons, three objects and two plates."""
    few = lambda c, k: F.slice(F.array_sort(F.collect_set(c)), 1, k).cast("array<string>").alias(c)
    seen = segments(spark, sf_dir).groupBy("session").agg(few("device", 3), few("part", 3), few("media_type", 2))
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    sources = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"))
    return sources.join(seen, "session", "left").select("session", F.concat(F.lit("persons: "), listed("device"), F.lit("; objects: "), listed("part"), F.lit("; plates: "), listed("media_type")).alias("seen"))


@query("feed_with_events", f"WITH {SIGHTINGS_SQL} SELECT d.o_orderkey AS delivery, s.event_id, s.device, s.event_id IS NULL AS event_deleted FROM orders d LEFT JOIN s ON s.event_id = d.o_orderkey")
def feed_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries survive the events they told of."""
    d, s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("delivery")), sightings(spark, sf_dir)
    return d.join(s, F.col("delivery") == F.col("event_id"), "left").select("delivery", "event_id", "device", F.col("event_id").isNull().alias("event_deleted"))


@query("device_count", f"WITH {SIGHTINGS_SQL} SELECT count(DISTINCT device) AS devices FROM s")
def device_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).agg(F.countDistinct("device").alias("devices"))
