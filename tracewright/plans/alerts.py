"""Events, alert rules, deliveries and their folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import severity_rank
from tracewright.functions.timeq import HOUR, SECOND, floor_div, hour_of_day, weekday_sunday
from tracewright.operators.folds import folded
from tracewright.registry import query
from tracewright.sources.driver_tables import SIGHTINGS_SQL, sightings

#: Severity of each kind of event; the kinds that are not listed are informative.
SEVERITY = {"purchase": "critical", "error": "critical", "click": "warning", "signup": "warning"}
#: Rules: id, kinds (empty: any), least severity, first and last hour of the day, days of the week from Sunday (empty: any), cooldown.
RULES = [
    (1, [], "critical", 0, 24, [], 3600), (2, ["click", "view"], "info", 8, 18, [1, 2, 3, 4, 5], 1800), (3, [], "warning", 22, 24, [], 7200), (4, ["login"], "info", 0, 24, [0, 6], 0),
]
BUCKET = 30 * SECOND
_SEV = "CASE device WHEN 'purchase' THEN 'critical' WHEN 'error' THEN 'critical' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'warning' ELSE 'info' END"
_RANK = "CASE severity WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 ELSE 1 END"
_EVENTS_SQL = f"{SIGHTINGS_SQL}, e AS (SELECT *, {_SEV} AS severity, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM s)"
_RULES_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}::VARCHAR[], {3 if s == 'critical' else 2 if s == 'warning' else 1}, {a}, {b}, {d}::INTEGER[], {c})" for i, k, s, a, b, d, c in RULES) + ") AS x(rule, kinds, least, h0, h1, days, cooldown))"
_MATCH_SQL = f"""{_EVENTS_SQL}, {_RULES_SQL}, h AS (SELECT rule, event_id, subject, start_ns, cooldown FROM e, r WHERE (len(kinds) = 0 OR list_contains(kinds, device)) AND {_RANK} >= least
  AND (start_ns // {HOUR}) % 24 >= h0 AND (start_ns // {HOUR}) % 24 < h1 AND (len(days) = 0 OR list_contains(days, CAST((start_ns // {24 * HOUR} + 4) % 7 AS INTEGER))))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p)), F.col("device")), F.lit("info"))
    return sightings(spark, sf_dir).withColumns({"severity": severity, "k": F.get_json_object("props", "$.k").cast("long")})


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule int, kinds array<string>, least string, h0 int, h1 int, days array<int>, cooldown int")


def matches(e: DataFrame, r: DataFrame) -> DataFrame:
    """Each event with every rule that it meets; rules are few and broadcast."""
    hour, day = hour_of_day(F.col("start_ns")), weekday_sunday(F.col("start_ns"))
    meets = ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("device"))) & (severity_rank(F.col("severity")) >= severity_rank(F.col("least")))
    meets &= (hour >= F.col("h0")) & (hour < F.col("h1")) & ((F.size("days") == 0) | F.array_contains("days", day))
    return e.join(F.broadcast(r), meets).select("rule", "event_id", "subject", "start_ns", "cooldown")


@query("events_feed", f"WITH {_EVENTS_SQL} SELECT event_id, device, severity, subject, start_ns FROM e WHERE {_RANK} >= 2 AND device <> 'view' ORDER BY start_ns DESC, event_id DESC LIMIT 100")
def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity is a floor by rank; at most a hundred, the newest first."""
    e = events(spark, sf_dir).where((severity_rank(F.col("severity")) >= 2) & (F.col("device") != "view"))
    return e.orderBy(F.desc("start_ns"), F.desc("event_id")).limit(100).select("event_id", "device", "severity", "subject", "start_ns")


@query("event_metadata", f"WITH {_EVENTS_SQL} SELECT device, count(*) AS n, count(DISTINCT k) AS kinds, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM e GROUP BY device")
def event_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("kinds"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query(
    "event_upsert",
    f"""WITH {_EVENTS_SQL}, b AS (SELECT *, start_ns // {6 * HOUR} AS bucket FROM e)
SELECT subject, device, bucket, arg_min(event_id, (start_ns, event_id)) AS first_event, min(start_ns) AS start_ns, max(end_ns) AS end_ns, round(max(value), 6) AS score, max({_RANK}) AS severity_rank, arg_max(event_id, (start_ns, event_id)) AS last_event, count(*) AS n FROM b GROUP BY subject, device, bucket""",
)
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key the first start and event, the greatest end, score and severity, and the last event."""
    e = events(spark, sf_dir).withColumn("bucket", floor_div(F.col("start_ns"), 6 * HOUR))
    at = F.struct("start_ns", "event_id")
    return e.groupBy("subject", "device", "bucket").agg(
        F.min_by("event_id", at).alias("first_event"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.round(F.max("value"), 6).alias("score"),
        F.max(severity_rank(F.col("severity"))).alias("severity_rank"), F.max_by("event_id", at).alias("last_event"), F.count(F.lit(1)).alias("n"),
    )


@query("bucket_sessions", f"WITH {SIGHTINGS_SQL} SELECT subject, device, start_ns // {BUCKET} AS bucket, min(start_ns) AS start_ns, max(end_ns) AS end_ns, round(max(value), 6) AS score, count(*) AS n FROM s GROUP BY ALL")
def bucket_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An appearance that crosses a bucket's edge is two events."""
    return sightings(spark, sf_dir).groupBy("subject", "device", floor_div(F.col("start_ns"), BUCKET).alias("bucket")).agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.round(F.max("value"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@query("alert_matches", f"WITH {_MATCH_SQL} SELECT rule, event_id, subject FROM h")
def alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(events(spark, sf_dir), rules(spark)).select("rule", "event_id", "subject")


def _cooled(last: int | None, start: int, cooldown: int) -> tuple[int, bool]:
    """The time of the last delivery, and whether this match is one."""
    return (start, True) if last is None or start - last >= cooldown * SECOND else (last, False)


@query(
    "alert_cooldown",
    f"""WITH RECURSIVE {_MATCH_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY rule, subject ORDER BY start_ns, event_id) AS k FROM h),
f AS (SELECT rule, subject, event_id, k, start_ns AS last, TRUE AS sent FROM n WHERE k = 1
  UNION ALL SELECT n.rule, n.subject, n.event_id, n.k, CASE WHEN n.start_ns - f.last >= CAST(n.cooldown AS BIGINT) * {SECOND} THEN n.start_ns ELSE f.last END, n.start_ns - f.last >= CAST(n.cooldown AS BIGINT) * {SECOND}
  FROM f JOIN n ON n.rule = f.rule AND n.subject = f.subject AND n.k = f.k + 1) SELECT rule, subject, event_id FROM f WHERE sent""",
)
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries after the cooldown of each rule and subject: a fold, since each delivery restarts the clock. After a
    silence of the cooldown's length the next match is sent for certain, so matches are cut there; only those that come
    sooner make runs to be folded."""
    w = W.partitionBy("rule", "subject").orderBy("start_ns", "event_id")
    quiet = F.coalesce(F.col("start_ns") - F.lag("start_ns").over(w) >= F.col("cooldown").cast("long") * SECOND, F.lit(True)).cast("long")
    cut = matches(events(spark, sf_dir), rules(spark)).withColumn("quiet", quiet).withColumn("run", F.sum("quiet").over(w.rowsBetween(W.unboundedPreceding, 0)))
    cut = cut.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("rule", "subject", "run")))
    sent = folded(cut.where("n > 1"), ["rule", "subject", "run"], ["start_ns", "event_id"], ["start_ns", "cooldown"], "sent", T.BooleanType(), _cooled).where("sent")
    return cut.where("n = 1").unionByName(sent.drop("sent")).select("rule", "subject", "event_id")


@query("alert_first_of_day", f"WITH {_MATCH_SQL} SELECT rule, subject, start_ns // {24 * HOUR} AS day, arg_min(event_id, (start_ns, event_id)) AS event_id FROM h GROUP BY 1, 2, 3")
def alert_first_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one for each rule, subject and civil day."""
    h = matches(events(spark, sf_dir), rules(spark))
    return h.groupBy("rule", "subject", floor_div(F.col("start_ns"), 24 * HOUR).alias("day")).agg(F.min_by("event_id", F.struct("start_ns", "event_id")).alias("event_id"))


@query("delivery_backoff", f"WITH {_EVENTS_SQL} SELECT event_id, k AS attempts, CAST(least(30 * pow(2, greatest(k, 1) - 1), 3600) AS BIGINT) AS wait_s, CASE WHEN k >= 8 THEN 'failed' ELSE 'retry' END AS state FROM e")
def delivery_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait doubles with each attempt up to an hour; after eight a delivery has failed."""
    wait = F.least(30 * F.pow(F.lit(2.0), F.greatest("k", F.lit(1)) - 1), F.lit(3600.0)).cast("long")
    return events(spark, sf_dir).select("event_id", F.col("k").alias("attempts"), wait.alias("wait_s"), F.when(F.col("k") >= 8, "failed").otherwise("retry").alias("state"))


@query(
    "recent_roster",
    f"WITH {SIGHTINGS_SQL} SELECT subject, max(start_ns) AS last_ns, arg_max(device, (start_ns, event_id)) AS device, count(*) AS n FROM s GROUP BY subject ORDER BY last_ns DESC, subject LIMIT 25",
)
def recent_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).groupBy("subject").agg(F.max("start_ns").alias("last_ns"), F.max_by("device", F.struct("start_ns", "event_id")).alias("device"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("last_ns"), "subject").limit(25)


@query(
    "sightings_by_device",
    f"WITH {SIGHTINGS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY device, subject ORDER BY start_ns DESC, event_id DESC) AS k FROM s) SELECT device, subject, string_agg(event_id, ',' ORDER BY k) AS latest FROM k WHERE k <= 3 GROUP BY device, subject",
)
def sightings_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest events of each subject at each device."""
    k = sightings(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("device", "subject").orderBy(F.desc("start_ns"), F.desc("event_id")))).where("k <= 3")
    return k.groupBy("device", "subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("latest"))


@query("best_shot", f"WITH {SIGHTINGS_SQL} SELECT subject, event_id, round(value, 6) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY value DESC NULLS LAST, start_ns, event_id) AS k FROM s) WHERE k = 1")
def best_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("subject").orderBy(F.desc_nulls_last("value"), "start_ns", "event_id"))
    return sightings(spark, sf_dir).withColumn("k", k).where("k = 1").select("subject", "event_id", F.round("value", 6).alias("quality"))


@query(
    "severity_pivot",
    f"WITH {_EVENTS_SQL} SELECT device, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'critical') AS critical FROM e GROUP BY device",
)
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("device").pivot("severity", ["info", "warning", "critical"]).count().fillna(0)
