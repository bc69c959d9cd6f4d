"""The entity graph: edges folded from visits, companions, journeys, anomalies and digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.timeq import DAY, HOUR, MINUTE, SECOND, civil_day
from tracewright.operators.edges import merged_edges, observed, renamed
from tracewright.operators.graphs import neighbourhood, shortest_paths
from tracewright.operators.intervals import number_runs
from tracewright.operators.meetings import Met, Valued, arrivals, valued
from tracewright.operators.scratch import written
from tracewright.plans.presence import _VISITS_SQL, stays, visits
from tracewright.registry import query
from tracewright.sources.driver_tables import SIGHTINGS_SQL, read, sightings

JOURNEY_GAP = 2 * HOUR


def customer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer - nation - region and supplier - nation; nodes are named by kind and key."""
    n = read(spark, sf_dir, "nation")
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edges = n.select(node("nation", "n_nationkey").alias("a"), node("region", "n_regionkey").alias("b"))
    edges = edges.unionByName(read(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("a"), node("nation", "c_nationkey").alias("b")))
    return edges.unionByName(read(spark, sf_dir, "supplier").select(node("supplier", "s_suppkey").alias("a"), node("nation", "s_nationkey").alias("b")))


_GRAPH_SQL = """ed AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed)"""


@query(
    "graph_neighbours",
    f"""WITH RECURSIVE {_GRAPH_SQL}, w AS (SELECT 'supplier:1' AS node, 0 AS depth UNION SELECT bo.b, depth + 1 FROM w JOIN bo ON bo.a = w.node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node HAVING min(depth) > 0""",
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("supplier:1",)], "node string")
    return neighbourhood(customer_graph(spark, sf_dir), start, 3)


@query(
    "graph_shortest_paths",
    f"""WITH RECURSIVE {_GRAPH_SQL}, w AS (SELECT 'supplier:1' AS node, ['supplier:1'] AS path UNION ALL SELECT bo.b, list_append(path, bo.b) FROM w JOIN bo ON bo.a = w.node WHERE len(path) < 4 AND NOT list_contains(path, bo.b)),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY len(path), path) AS k FROM w WHERE len(path) > 1) SELECT node, array_to_string(path, '>') AS path FROM k WHERE k = 1""",
)
def graph_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("supplier:1",)], "node string")
    return shortest_paths(customer_graph(spark, sf_dir), start, 3).select("node", F.array_join("path", ">").alias("path"))


@query("edge_listing", f"WITH {_GRAPH_SQL}, d AS (SELECT a AS node, b FROM bo) SELECT node, count(*) AS degree FROM d GROUP BY node ORDER BY degree DESC, node LIMIT 30")
def edge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customer_graph(spark, sf_dir)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(30)


def _kinds(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons and vehicles: subjects of even and of odd number."""
    return v.where("subject % 2 = 0"), v.where("subject % 2 = 1")


def _two_kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _kinds(written(stays(spark, sf_dir).drop("visit")))


_TWO_SQL = f"{_VISITS_SQL}, pe AS (SELECT * FROM vi WHERE subject % 2 = 0), ve AS (SELECT * FROM vi WHERE subject % 2 = 1)"


@query(
    "arrived_with_vehicle",
    f"""WITH {_TWO_SQL} SELECT pe.subject AS person, ve.subject AS vehicle, count(*) AS observation_count, min(least(pe.start_ns, ve.start_ns)) AS first_seen, max(greatest(pe.end_ns, ve.end_ns)) AS last_seen
FROM pe JOIN ve ON pe.device = ve.device AND abs(ve.start_ns - pe.start_ns) <= {3 * MINUTE} GROUP BY 1, 2""",
)
def arrived_with_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(m: Met) -> dict:
        first, last = np.minimum(m.a["start"][m.i], m.b["start"][m.j]), np.maximum(m.a["end"][m.i], m.b["end"][m.j])
        return {"person": m.x, "vehicle": m.y, "observation_count": m.count(), "first_seen": m.fold(np.minimum, first), "last_seen": m.fold(np.maximum, last)}

    return arrivals(*_two_kinds(spark, sf_dir), 3 * MINUTE, fold, "person long, vehicle long, observation_count long, first_seen long, last_seen long")


@query(
    "binding_confidence",
    f"""WITH {_TWO_SQL}, tr AS (SELECT DISTINCT pe.subject AS person, pe.visit AS visit, ve.subject AS vehicle FROM pe JOIN ve ON pe.device = ve.device AND pe.start_ns - ve.end_ns < {MINUTE} AND ve.start_ns - pe.end_ns < {MINUTE}),
tg AS (SELECT person, vehicle, count(*) AS together FROM tr GROUP BY 1, 2), al AS (SELECT subject, count(*) AS n FROM vi GROUP BY subject),
cf AS (SELECT person, vehicle, together, round(together / al.n, 4) AS confidence FROM tg JOIN al ON al.subject = person),
rn AS (SELECT *, coalesce(max(confidence) OVER (PARTITION BY person ORDER BY confidence DESC, vehicle ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0) AS runner_up, row_number() OVER (PARTITION BY person ORDER BY confidence DESC, vehicle) AS k FROM cf)
SELECT person, vehicle, together, confidence, runner_up, together >= 3 AND confidence >= 0.01 AND confidence - runner_up >= 0.002 AS surfaced FROM rn WHERE k = 1""",
)
def binding_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle that most of a person's visits overlap, as a share of all of them, and how far ahead it is.

    A visit counts with the first of a vehicle's visits that it overlaps, the one before which none of them ended late enough."""
    v = written(visits(spark, sf_dir).select("subject", "visit", "device", F.col("start_ns").alias("start"), F.col("end_ns").alias("end")))
    before = F.max("end").over(W.partitionBy("subject", "device").orderBy("start", "visit").rowsBetween(W.unboundedPreceding, -1))
    persons, vehicles = (k.dropna().withColumn("before", F.coalesce(b + MINUTE, F.lit(-(1 << 62)))).drop("visit") for k, b in zip(_kinds(v), (F.lit(None).cast("long"), before), strict=True))

    def fold(m: Valued) -> dict:
        """Of as many visits together the first two vehicles in each block: the two that come first are among them."""
        return dict(zip(("person", "vehicle", "together"), m.least(2), strict=True))

    together = valued(persons, vehicles, MINUTE, lambda x, y: y["before"] <= x["start"], np.add, fold, "person long, vehicle long, together long")
    total = v.groupBy(F.col("subject").alias("person")).agg(F.count(F.lit(1)).alias("n"))
    c = together.join(total, "person").withColumn("confidence", F.round(F.col("together") / F.col("n"), 4))
    order = W.partitionBy("person").orderBy(F.desc("confidence"), "vehicle")
    c = c.withColumns({"k": F.row_number().over(order), "runner_up": F.coalesce(F.lead("confidence").over(order), F.lit(0.0))})
    surfaced = (F.col("together") >= 3) & (F.col("confidence") >= 0.01) & (F.col("confidence") - F.col("runner_up") >= 0.002)
    return c.where("k = 1").select("person", "vehicle", "together", "confidence", "runner_up", surfaced.alias("surfaced"))


@query(
    "new_vehicle",
    f"""WITH {_TWO_SQL}, ed AS (SELECT pe.subject AS person, ve.subject AS vehicle, min(greatest(pe.start_ns, ve.start_ns)) AS first_seen FROM pe JOIN ve ON pe.device = ve.device AND abs(ve.start_ns - pe.start_ns) <= {3 * MINUTE} GROUP BY 1, 2),
ea AS (SELECT *, min(first_seen) OVER (PARTITION BY person) AS earliest FROM ed) SELECT person, vehicle, first_seen FROM ea WHERE first_seen > earliest""",
)
def new_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals with a vehicle other than the person's first: each person's first is found before, so that no pair has to wait for it."""
    a, b = _two_kinds(spark, sf_dir)

    def first_seen(m: Met) -> np.ndarray:
        return m.fold(np.minimum, np.maximum(m.a["start"][m.i], m.b["start"][m.j]))

    def first(m: Met) -> dict:
        at = np.flatnonzero(np.diff(m.x, prepend=m.x[0] - 1))
        return {"subject": m.x[at], "earliest": np.minimum.reduceat(first_seen(m), at)}

    def later(m: Met) -> dict:
        seen, earliest = first_seen(m), m.a["earliest"][m.i[m.first]]
        at = np.flatnonzero(seen > earliest)
        return {"person": m.x[at], "vehicle": m.y[at], "first_seen": seen[at]}

    earliest = written(arrivals(a, b, 3 * MINUTE, first, "subject long, earliest long").groupBy("subject").agg(F.min("earliest").alias("earliest")))
    return arrivals(a.join(earliest, "subject"), b.withColumn("earliest", F.lit(0).cast("long")).select(*a.columns, "earliest"), 3 * MINUTE, later, "person long, vehicle long, first_seen long")


def _first_of_three(t: pa.Table) -> pa.Table:
    """The first visit of a day with at least three subjects, of its visits (``first`` is their day) and those that meet them."""
    t = t.sort_by([("start", "ascending"), ("subject", "ascending"), ("visit", "ascending")])
    subject, start, end = (np.asarray(t.column(c).combine_chunks()) for c in ("subject", "start", "end"))
    latest = np.maximum.accumulate(end)
    for i in np.flatnonzero(np.asarray(t.column("first").combine_chunks()) == t.column("day")[0].as_py()):
        low, high = np.searchsorted(latest, start[i] - MINUTE, "right"), np.searchsorted(start, end[i] + MINUTE, "left")
        n = len(np.unique(subject[low:high][end[low:high] > start[i] - MINUTE]))
        if n >= 3:
            row = t.slice(int(i), 1)
            return row.select(["device", "subject", "visit"]).append_column("start_ns", row.column("start")).append_column("n", pa.array([n], pa.int64()))
    return pa.table({"device": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("subject", "visit", "start_ns", "n")}})


@query(
    "unknown_clusters",
    f"""WITH {_VISITS_SQL}, pr AS (SELECT a.device, a.subject, a.visit, a.start_ns, count(DISTINCT b.subject) AS n FROM vi a JOIN vi b ON a.device = b.device AND a.start_ns < b.end_ns + {MINUTE} AND b.start_ns < a.end_ns + {MINUTE} GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY device, start_ns // {DAY} ORDER BY start_ns, subject, visit) AS k FROM pr WHERE n >= 3) SELECT device, subject, visit, start_ns, n FROM k WHERE k = 1""",
)
def unknown_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first visit of each device and day during which at least three subjects were there.

    A device's day has the visits that start in it and all that meet one of them; they are looked at in order up to the first."""
    day = lambda c: civil_day(F.col(c))
    v = written(stays(spark, sf_dir).withColumns({"day": day("start"), "until": F.greatest(civil_day(F.col("end") + MINUTE), day("start"))}))
    reach = v.groupBy("device", "day").agg(F.max("until").alias("until"))
    reach = reach.select("device", "day", F.explode(F.sequence("day", "until")).alias("at"))
    there = v.select("device", "subject", "visit", "start", "end", F.col("day").alias("first"), F.explode(F.sequence("day", "until")).alias("at"))
    # Two spans of days that touch have one first day in common.
    near = there.join(reach, ["device", "at"]).where((F.col("at") == F.col("day")) | (F.col("at") == F.col("first")))
    return near.groupBy("device", "day").applyInArrow(_first_of_three, "device string, subject long, visit long, start_ns long, n long")


@query(
    "first_time_pairs",
    f"""WITH {_VISITS_SQL}, pr AS (SELECT a.subject AS x, b.subject AS y, min(greatest(a.start_ns, b.start_ns)) AS moment FROM vi a JOIN vi b ON a.device = b.device AND a.subject < b.subject AND a.start_ns < b.end_ns + {MINUTE} AND b.start_ns < a.end_ns + {MINUTE} GROUP BY 1, 2)
SELECT moment // {DAY} AS day, count(*) AS pairs FROM pr GROUP BY 1""",
)
def first_time_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a pair only the day counts on which the later one of its first meeting came."""
    v = written(stays(spark, sf_dir).drop("visit").withColumn("day", civil_day(F.col("start")).cast("int")))

    def fold(m: Valued) -> dict:
        pairs = np.bincount(m.values - (first := int(m.values.min())))
        return {"day": (at := np.flatnonzero(pairs)) + first, "pairs": pairs[at]}

    return valued(v, None, MINUTE, lambda x, y: np.maximum(x["day"], y["day"]), np.minimum, fold, "day long, pairs long").groupBy("day").agg(F.sum("pairs").alias("pairs"))


def hops(v: DataFrame, gap: int, subject: str = "subject") -> DataFrame:
    """Visits with their ``journey`` and ``stay`` (both numbered by subject): a journey goes on while a visit begins at most
    ``gap`` after the end of the hop before, and visits to the same device in turn are one hop.

    A hop's end is the latest of its visits, and a journey breaks only after it; so the running latest end of a stay at a
    device is the hop's, also after a break, and windows settle it all."""
    w = W.partitionBy(subject).orderBy("start_ns", "end_ns", "device")
    moved = F.coalesce((F.lag("device").over(w) != F.col("device")).cast("long"), F.lit(1))
    stays = number_runs(v.withColumn("moved", moved), [subject], "start_ns", "end_ns", "device", flag="moved", name="stay").drop("moved")
    stays = stays.withColumn("reach", F.max("end_ns").over(W.partitionBy(subject, "stay").orderBy("start_ns", "end_ns").rowsBetween(W.unboundedPreceding, 0)))
    cut = F.coalesce((F.col("start_ns") - F.lag("reach").over(w) > gap).cast("long"), F.lit(1))
    return number_runs(stays.withColumn("cut", cut), [subject], "start_ns", "end_ns", "device", flag="cut", name="journey").drop("cut", "reach")


def stitched(v: DataFrame, gap: int) -> DataFrame:
    """``subject, start_ns, end_ns, devices`` of journeys to at least two devices, with a device for each hop."""
    hop = hops(v, gap).groupBy("subject", "journey", "stay").agg(F.first("device").alias("device"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    ordered = F.array_sort(F.collect_list(F.struct("stay", "device")))
    made = hop.groupBy("subject", "journey").agg(F.min("start_ns").alias("start_ns"), F.max_by("end_ns", "stay").alias("end_ns"), F.transform(ordered, lambda x: x["device"]).alias("devices"))
    return made.where("size(devices) > 1").drop("journey")


_HOPS_SQL = f"""{_VISITS_SQL}, mo AS (SELECT *, CASE WHEN lag(device) OVER w IS DISTINCT FROM device THEN 1 ELSE 0 END AS moved FROM vi WINDOW w AS (PARTITION BY subject ORDER BY start_ns, end_ns, device)),
sy AS (SELECT *, sum(moved) OVER (PARTITION BY subject ORDER BY start_ns, end_ns, device) AS stay FROM mo),
re AS (SELECT *, max(end_ns) OVER (PARTITION BY subject, stay ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS reach FROM sy),
cu AS (SELECT *, CASE WHEN start_ns - lag(reach) OVER w <= {JOURNEY_GAP} THEN 0 ELSE 1 END AS cut FROM re WINDOW w AS (PARTITION BY subject ORDER BY start_ns, end_ns, device)),
jo AS (SELECT *, sum(cut) OVER (PARTITION BY subject ORDER BY start_ns, end_ns, device) AS journey FROM cu),
ho AS (SELECT subject, journey, stay, any_value(device) AS device, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM jo GROUP BY 1, 2, 3)"""


@query(
    "journeys",
    f"WITH {_HOPS_SQL} SELECT subject, min(start_ns) AS start_ns, arg_max(end_ns, stay) AS end_ns, string_agg(device, '>' ORDER BY stay) AS hops FROM ho GROUP BY subject, journey HAVING count(*) > 1",
)
def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = stitched(visits(spark, sf_dir).select("subject", "device", "start_ns", "end_ns"), JOURNEY_GAP)
    return j.select("subject", "start_ns", "end_ns", F.array_join("devices", ">").alias("hops"))


@query(
    "camera_adjacency",
    f"""WITH {_HOPS_SQL}, sp AS (SELECT lag(device) OVER w AS a, device AS b, start_ns - lag(end_ns) OVER w AS gap FROM ho WINDOW w AS (PARTITION BY subject, journey ORDER BY stay))
SELECT a, b, count(*) AS n, min(gap) AS min_gap, max(gap) AS max_gap FROM sp WHERE a IS NOT NULL GROUP BY a, b""",
)
def camera_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a journey goes from one device straight to another, and the least and the most time between."""
    hop = hops(visits(spark, sf_dir).select("subject", "device", "start_ns", "end_ns"), JOURNEY_GAP)
    hop = hop.groupBy("subject", "journey", "stay").agg(F.first("device").alias("b"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    w = W.partitionBy("subject", "journey").orderBy("stay")
    steps = hop.select(F.lag("b").over(w).alias("a"), "b", (F.col("start_ns") - F.lag("end_ns").over(w)).alias("gap")).where("a is not null")
    return steps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


@query(
    "daily_digest",
    f"""WITH {_VISITS_SQL}, dy AS (SELECT start_ns // {DAY} AS day, subject, count(*) AS n FROM vi GROUP BY 1, 2), fs AS (SELECT subject, min(start_ns) // {DAY} AS day FROM vi GROUP BY 1),
tp AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, subject) AS k FROM dy)
SELECT t.day, string_agg(t.subject || '=' || t.n, ',' ORDER BY k) FILTER (WHERE k <= 10) AS top_visitors, count(*) AS visitors, CAST(sum(t.n) AS BIGINT) AS visits, count(*) FILTER (WHERE fs.day IS NOT NULL) AS new_subjects
FROM tp t LEFT JOIN fs ON fs.subject = t.subject AND fs.day = t.day GROUP BY t.day""",
)
def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's ten top visitors, all its visitors and visits, and who was seen for the first time."""
    v = visits(spark, sf_dir).withColumn("day", civil_day(F.col("start_ns")))
    first = v.groupBy("subject").agg(F.min("day").alias("day")).withColumn("new", F.lit(1))
    n = v.groupBy("day", "subject").agg(F.count(F.lit(1)).alias("n")).join(first, ["day", "subject"], "left")
    n = n.withColumn("k", F.row_number().over(W.partitionBy("day").orderBy(F.desc("n"), "subject")))
    entry = F.when(F.col("k") <= 10, F.struct("k", F.concat_ws("=", "subject", "n").alias("s")))
    return n.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(entry))["s"], ",").alias("top_visitors"), F.count(F.lit(1)).alias("visitors"), F.sum("n").alias("visits"), F.count("new").alias("new_subjects"))


@query(
    "edge_merge",
    f"""WITH {_VISITS_SQL}, pl AS (SELECT subject, device, count(*) AS n, min(start_ns) AS f, max(end_ns) AS l FROM vi GROUP BY 1, 2)
SELECT subject - subject % 3 AS survivor, device, CAST(sum(n) AS BIGINT) AS observation_count, min(f) AS first_seen, max(l) AS last_seen FROM pl GROUP BY 1, 2""",
)
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after identities have been merged by threes: counts add up, the span is the union."""
    places = visits(spark, sf_dir).groupBy("subject", "device").agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("f"), F.max("end_ns").alias("l"))
    return places.groupBy((F.col("subject") - F.col("subject") % 3).alias("survivor"), "device").agg(F.sum("n").alias("observation_count"), F.min("f").alias("first_seen"), F.max("l").alias("last_seen"))


def sighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting as an edge of its subject to the device; two of three tell a confidence, odd ones something more."""
    k = F.get_json_object("props", "$.k")
    more = F.create_map(F.lit("k"), k, F.lit("odd"), F.when(F.col("event_id") % 2 == 1, F.col("event_id").cast("string")))
    confidence = F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") / 500, 4))
    return observed(sightings(spark, sf_dir), F.lit("visits"), F.col("subject"), F.col("device"), F.col("event_id"), F.col("start_ns"), F.col("end_ns"), confidence, more)


_EDGE_COLUMNS = """CAST(sum(n) AS BIGINT) AS n, min(start_ns) AS first_ns, max(end_ns) AS last_ns, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 16) AS evidence,
  arg_max(round(value / 500, 4), (start_ns, event_id)) FILTER (WHERE event_id % 3 <> 0) AS confidence, arg_max(json_extract_string(props, '$.k'), (start_ns, event_id)) AS meta_k, arg_max(CAST(event_id AS VARCHAR), (start_ns, event_id)) FILTER (WHERE event_id % 2 = 1) AS meta_odd"""


def _told(edges: DataFrame) -> DataFrame:
    evidence = F.array_join(F.transform("evidence", lambda s: s["event"].cast("string")), ",").alias("evidence")
    return edges.select("src", "dst", "n", "first_ns", "last_ns", evidence, F.col("confidence.value").alias("confidence"), F.col("metadata")["k"]["value"].alias("meta_k"), F.col("metadata")["odd"]["value"].alias("meta_odd"))


@query(
    "edge_fold",
    f"""WITH {SIGHTINGS_SQL}, o AS (SELECT *, 1 AS n, row_number() OVER (PARTITION BY subject, device ORDER BY start_ns DESC, event_id) AS k FROM s)
SELECT CAST(subject AS VARCHAR) AS src, device AS dst, {_EDGE_COLUMNS} FROM o GROUP BY subject, device""",
)
def edge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of four folds of the sightings."""
    s = sighted(spark, sf_dir)
    part = F.pmod(F.col("first_ns"), F.lit(4))
    parts = [merged_edges(s.where(part == k)) for k in range(4)]
    return _told(merged_edges(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])))


@query(
    "edges_of_merged_subjects",
    f"""WITH {SIGHTINGS_SQL}, o AS (SELECT *, 1 AS n, subject - subject % 3 AS survivor, row_number() OVER (PARTITION BY subject - subject % 3, device ORDER BY start_ns DESC, event_id) AS k FROM s)
SELECT CAST(survivor AS VARCHAR) AS src, device AS dst, {_EDGE_COLUMNS} FROM o GROUP BY survivor, device""",
)
def edges_of_merged_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored edges after subjects have been merged by threes: each is renamed and what falls together is folded."""
    edges = merged_edges(sighted(spark, sf_dir))
    subjects = edges.select(F.col("src").alias("id")).distinct().withColumn("survivor", (F.col("id").cast("long") - F.col("id").cast("long") % 3).cast("string"))
    return _told(merged_edges(renamed(edges, subjects)))


#: A journey is closed when its last hop ended this long before the newest sighting.
CLOSED_AFTER = JOURNEY_GAP + 90 * SECOND


@query(
    "journey_states",
    f"""WITH {_HOPS_SQL}, jn AS (SELECT subject, min(start_ns) AS start_ns, arg_max(end_ns, stay) AS end_ns, count(*) AS hops FROM ho GROUP BY subject, journey HAVING count(*) > 1)
SELECT subject, 'journey:' || subject || ':' || start_ns AS key, end_ns, hops, CASE WHEN end_ns < (SELECT max(start_ns) FROM vi) - {CLOSED_AFTER} THEN 'closed' ELSE 'open' END AS status FROM jn""",
)
def journey_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys by the key of their first hop, open while another hop may still follow the last one."""
    v = visits(spark, sf_dir).select("subject", "device", "start_ns", "end_ns")
    now = v.agg(F.max("start_ns").alias("now"))  # one row
    key = F.concat_ws(":", F.lit("journey"), F.col("subject").cast("string"), F.col("start_ns").cast("string"))
    status = F.when(F.col("end_ns") < F.col("now") - CLOSED_AFTER, "closed").otherwise("open")
    return stitched(v, JOURNEY_GAP).join(F.broadcast(now), F.lit(True)).select("subject", key.alias("key"), "end_ns", F.size("devices").cast("long").alias("hops"), status.alias("status"))
