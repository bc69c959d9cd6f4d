"""Pages of the entity graph: entities, bindings, watch lists, profiles, resolution, cascades and per-subject folds."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.timeq import DAY, HOUR
from tracewright.operators.meetings import least_of, shared_cells
from tracewright.operators.scratch import written
from tracewright.plans.presence import _VISITS_SQL, visits
from tracewright.plans.relations import _GRAPH_SQL, customer_graph
from tracewright.registry import query
from tracewright.sources.driver_tables import SEGMENTS_SQL, SIGHTINGS_SQL, read, segments, sightings

COOLDOWN, PROFILE_LINES = 1_800, 3

#: Bindings of a voice (odd) to a face (even): how often both were at one device in the same hours.
_BIND = f"""{SIGHTINGS_SQL}, q AS (SELECT subject, device, start_ns // (12 * {HOUR}) AS cell FROM s GROUP BY ALL), o AS (SELECT a.subject AS voice, b.subject AS face, count(*) AS shared FROM q a JOIN q b USING (device, cell) WHERE a.subject % 2 = 1 AND b.subject % 2 = 0 GROUP BY ALL),
n AS (SELECT subject, count(*) AS n FROM q GROUP BY subject), b AS (SELECT voice, face, shared, CASE WHEN shared >= 3 THEN round(shared / n.n, 4) END AS confidence, CASE shared % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'proposed' ELSE 'rejected' END AS status FROM o JOIN n ON n.subject = voice)"""


Keep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Which = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _pairs_kept(keep: Keep | None, which: Which | None = None) -> Callable[..., dict]:
    def fold(x: np.ndarray, y: np.ndarray, n: np.ndarray, shared: np.ndarray) -> dict:
        i, j = np.nonzero(shared if which is None else which(n, shared))
        made = x[i], y[j], n[i], shared[i, j].astype(np.int64)
        at = slice(None) if keep is None else keep(*made)
        return dict(zip(("voice", "face", "n", "shared"), (c[at] for c in made), strict=True))

    return fold


def _confidence(shared: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As ``bindings`` has it, -1 for none: half up by the decimal digits of the share."""
    both, at = np.unique(np.stack([shared, n]), axis=1, return_inverse=True)
    told = [float(Decimal(repr(int(s) / int(k))).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if s >= 3 else -1.0 for s, k in both.T]
    return np.array(told)[at.reshape(-1)]


def _surest(most: int) -> Callable[..., np.ndarray]:
    """The ``most`` proposed pairs that come first; what is first of all is first in its block."""

    def keep(voice: np.ndarray, face: np.ndarray, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(shared % 3 == 1)
        sure = _confidence(shared[at], n[at])
        if len(at) > most:
            near = sure >= np.partition(sure, len(at) - most)[len(at) - most]
            at, sure = at[near], sure[near]
        return at[np.lexsort((face[at], voice[at], -sure))[:most]]

    return keep


def _may_be_surest(most: int) -> Which:
    """Flags the proposed pairs whose share, before it is rounded, does not rule out that they are among the ``most`` surest."""

    def which(n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        proposed = shared % 3 == 1
        told = proposed & (shared >= 3)
        if np.count_nonzero(told) < most:
            return proposed
        share = np.where(told, shared / n[:, None].astype(np.float32), np.float32(-1))
        limit = np.partition(share, share.size - most, axis=None)[share.size - most]
        # Rounding to four digits moves two shares by at most 1e-4 towards each other.
        return share >= limit - np.float32(2e-4)

    return which


def bindings(spark: SparkSession, sf_dir: str, keep: Keep | None = None, which: Which | None = None) -> DataFrame:
    """All bindings, or of each few voices and block of faces the rows that ``keep(voice, face, n, shared)`` tells, of those
    whose cell of the matrix of numbers ``which(n, shared)`` flags.

    Pairs are counted in blocks of voices and faces and not shuffled."""
    q = written(sightings(spark, sf_dir).select("subject", "device", F.expr(f"start_ns div {12 * HOUR}").alias("cell")).dropna().distinct())
    o = shared_cells(q.where("subject % 2 = 1"), q.where("subject % 2 = 0"), _pairs_kept(keep, which), "voice long, face long, n long, shared long")
    status = F.when(F.col("shared") % 3 == 0, "confirmed").when(F.col("shared") % 3 == 1, "proposed").otherwise("rejected")
    return o.select("voice", "face", "shared", F.when(F.col("shared") >= 3, F.round(F.col("shared") / F.col("n"), 4)).alias("confidence"), status.alias("status"))


@query("binding_queue", f"WITH {_BIND} SELECT voice, face, confidence FROM b WHERE status = 'proposed' ORDER BY confidence DESC NULLS LAST, voice, face LIMIT 50")
def binding_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits to be confirmed, the surest first."""
    return bindings(spark, sf_dir, _surest(50), _may_be_surest(50)).where("status = 'proposed'").orderBy(F.desc_nulls_last("confidence"), "voice", "face").limit(50).select("voice", "face", "confidence")


@query("bound_faces", f"WITH {_BIND} SELECT voice, arg_max(face, (coalesce(confidence, -1), -face)) AS face FROM b WHERE status = 'confirmed' GROUP BY voice")
def bound_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed face of each voice, the surest if there are several; of as sure ones the first is kept in each block."""
    best = F.max_by("face", F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col("face")).alias("f")))
    first = bindings(spark, sf_dir, lambda voice, face, n, shared: least_of(1, voice, face, shared))
    return first.where("status = 'confirmed'").groupBy("voice").agg(best.alias("face"))


@query("owner_seed", f"WITH {_BIND} SELECT voice, face, confidence, shared FROM b WHERE status = 'confirmed' AND voice <> 1 UNION ALL SELECT 1, 0, 1.0, 0")
def owner_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed edges with the owner's, which is given and was never observed."""
    own = spark.createDataFrame([(1, 0, 1.0, 0)], "voice long, face long, confidence double, shared long")
    confirmed = bindings(spark, sf_dir, which=lambda n, shared: (shared > 0) & (shared % 3 == 0))
    return confirmed.where("status = 'confirmed' and voice <> 1").select("voice", "face", "confidence", "shared").unionByName(own)


@query("entity_page", f"WITH {_GRAPH_SQL} SELECT split_part(b, ':', 1) AS kind, count(*) AS edges, string_agg(b, ',' ORDER BY b) AS nodes FROM bo WHERE a = 'nation:3' GROUP BY 1")
def entity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of one node by the kind of their other end."""
    e = customer_graph(spark, sf_dir)
    other = e.where("a = 'nation:3'").select(F.col("b").alias("x")).unionByName(e.where("b = 'nation:3'").select(F.col("a").alias("x"))).distinct()
    return other.groupBy(F.split("x", ":")[0].alias("kind")).agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.array_sort(F.collect_list("x")), ",").alias("nodes"))


@query("entity_timeline", f"WITH {SIGHTINGS_SQL} SELECT event_id, device, start_ns FROM s WHERE subject = 3 AND start_ns < (SELECT max(start_ns) FROM s) ORDER BY start_ns DESC, event_id DESC LIMIT 25")
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject's newest events before a moment."""
    s = sightings(spark, sf_dir)
    before = s.agg(F.max("start_ns").alias("before"))  # one row
    mine = s.where("subject = 3").join(F.broadcast(before), F.col("start_ns") < F.col("before"))
    return mine.orderBy(F.desc("start_ns"), F.desc("event_id")).limit(25).select("event_id", "device", "start_ns")


@query("delete_cascade", f"WITH {_GRAPH_SQL}, gone AS (SELECT 'nation:' || n_nationkey AS node FROM nation WHERE n_nationkey % 4 = 0) SELECT a, b FROM ed WHERE a NOT IN (SELECT node FROM gone) AND b NOT IN (SELECT node FROM gone)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without those that touch a deleted node."""
    gone = read(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    e = customer_graph(spark, sf_dir)
    return e.join(gone, F.col("a") == F.col("node"), "left_anti").join(gone, F.col("b") == F.col("node"), "left_anti")


@query(
    "device_teardown",
    f"""WITH {SEGMENTS_SQL}, kept AS (SELECT * FROM g WHERE device % 10 <> 3) SELECT 'segments' AS what, count(*) AS n FROM kept UNION ALL SELECT 'sessions', count(DISTINCT session) FROM kept UNION ALL SELECT 'blobs_freed', count(*) FROM (SELECT DISTINCT part FROM g WHERE device % 10 = 3 AND part NOT IN (SELECT part FROM kept)) UNION ALL SELECT 'orphaned_references', count(*) FROM g WHERE device % 10 = 3 AND session IN (SELECT session FROM kept)""",
)
def device_teardown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when devices go: their segments too, blobs that no other segment needs, and references set to null."""
    g = segments(spark, sf_dir)
    gone, kept = g.where("device % 10 = 3"), g.where("device % 10 <> 3")
    said = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    freed = gone.select("part").distinct().join(kept.select("part"), "part", "left_anti")
    return said("segments", kept).unionByName(said("sessions", kept.select("session").distinct())).unionByName(said("blobs_freed", freed)).unionByName(said("orphaned_references", gone.join(kept.select("session").distinct(), "session", "left_semi")))


@query(
    "profiles",
    f"""WITH {_VISITS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_ns DESC, visit DESC) AS k, count(*) OVER (PARTITION BY subject) AS held FROM vi)
SELECT subject, CASE WHEN max(held) > {PROFILE_LINES} THEN max(held) - {PROFILE_LINES} || ' earlier visits | ' ELSE '' END || string_agg(device || ' for ' || (end_ns - start_ns) // 60000000000 || ' min', ' | ' ORDER BY k DESC) FILTER (WHERE k <= {PROFILE_LINES}) AS profile FROM k GROUP BY subject""",
)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each of a subject's last visits; those before are rolled up into one."""
    w = W.partitionBy("subject")
    k = visits(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy(F.desc("start_ns"), F.desc("visit"))), "held": F.count(F.lit(1)).over(w)})
    line = F.concat("device", F.lit(" for "), F.expr("(end_ns - start_ns) div 60000000000").cast("string"), F.lit(" min"))
    k = k.where(F.col("k") <= PROFILE_LINES).groupBy("subject").agg(F.max("held").alias("held"), F.sort_array(F.collect_list(F.struct("k", line.alias("x"))), asc=False).alias("l"))
    earlier = F.when(F.col("held") > PROFILE_LINES, F.concat((F.col("held") - PROFILE_LINES).cast("string"), F.lit(" earlier visits | "))).otherwise("")
    return k.select("subject", F.concat(earlier, F.array_join(F.transform("l", lambda r: r["x"]), " | ")).alias("profile"))


@query(
    "watchlist",
    f"WITH {SIGHTINGS_SQL}, l AS (SELECT subject, max(start_ns) AS last_ns FROM s GROUP BY subject) SELECT c_custkey AS subject, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, 'subject ' || c_custkey) AS label, 'watch:' || c_custkey AS rule, {COOLDOWN} AS cooldown_s, last_ns FROM customer LEFT JOIN l ON subject = c_custkey WHERE c_acctbal < 0",
)
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is watched, by name or number, the managed rule and when last seen."""
    last = sightings(spark, sf_dir).groupBy("subject").agg(F.max("start_ns").alias("last_ns"))
    key = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(key.alias("subject"), F.coalesce(F.when(key % 3 == 0, F.col("c_name")), F.concat(F.lit("subject "), key.cast("string"))).alias("label"), F.concat(F.lit("watch:"), key.cast("string")).alias("rule"), F.lit(COOLDOWN).alias("cooldown_s"))
    return c.join(last, "subject", "left")


@query(
    "resolved_nodes",
    """WITH q(q) AS (VALUES ('%1'), ('germany'), ('widget%'), ('nobody')), c AS (SELECT q, 1 AS rank, c_custkey AS id, 'person' AS kind FROM q JOIN customer ON c_name ILIKE q UNION ALL SELECT q, 2, p_partkey, 'plate' FROM q JOIN part ON p_name ILIKE '%' || q UNION ALL SELECT q, 3, n_nationkey, 'speaker' FROM q JOIN nation ON n_name ILIKE q)
SELECT q AS name, arg_min(kind, (rank, id)) AS kind, arg_min(id, (rank, id)) AS id FROM c GROUP BY q""",
)
def resolved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were asked for: a person first, then a plate, then a speaker, the smallest id of its kind."""
    q = spark.createDataFrame([("%1",), ("germany",), ("widget%",), ("nobody",)], "name string")
    lanes = [(1, "customer", "c_name", "c_custkey", "person", ""), (2, "part", "p_name", "p_partkey", "plate", "%"), (3, "nation", "n_name", "n_nationkey", "speaker", "")]
    found = None
    for rank, table, name, key, kind, before in lanes:
        rows = read(spark, sf_dir, table).select(F.col(name).alias("said"), F.col(key).alias("id"))
        hit = rows.join(F.broadcast(q), F.expr(f"said ilike concat('{before}', name)")).groupBy("name").agg(F.min("id").alias("id")).select("name", F.struct(F.lit(rank).alias("rank"), "id", F.lit(kind).alias("kind")).alias("m"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("name").agg(F.min("m").alias("m")).select("name", "m.kind", "m.id")


@query(
    "fresh_events",
    f"""WITH {SIGHTINGS_SQL}, p AS (SELECT subject, min(start_ns) + (subject % 5) * {DAY} AS watermark FROM s WHERE subject % 4 <> 0 GROUP BY subject)
SELECT s.subject, count(*) AS fresh, max(start_ns) AS watermark FROM s LEFT JOIN p ON p.subject = s.subject WHERE start_ns > coalesce(watermark, 0) GROUP BY s.subject""",
)
def fresh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came past each subject's own watermark, and where that moves to; a subject without one starts from nothing."""
    s = sightings(spark, sf_dir)
    marks = s.where("subject % 4 <> 0").groupBy("subject").agg((F.min("start_ns") + (F.col("subject") % 5) * DAY).alias("mark"))
    return s.join(marks, "subject", "left").where(F.col("start_ns") > F.coalesce("mark", F.lit(0))).groupBy("subject").agg(F.count(F.lit(1)).alias("fresh"), F.max("start_ns").alias("watermark"))


@query("roster_briefing", f"WITH {SIGHTINGS_SQL}, n AS (SELECT subject, count(*) AS n FROM s GROUP BY subject), x AS (SELECT *, CASE WHEN subject % 3 = 0 THEN 'Customer ' || subject END AS name FROM n) SELECT (SELECT string_agg(name, ', ' ORDER BY n DESC, name) FROM (SELECT * FROM x WHERE name IS NOT NULL ORDER BY n DESC, name LIMIT 5)) AS known, count(*) FILTER (WHERE name IS NULL) AS unnamed, (SELECT count(DISTINCT device) FROM s) AS devices, (SELECT max(start_ns) FROM s) AS last_ns FROM x")
def roster_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most seen by name, how many have none, how many devices, and the last activity."""
    s = sightings(spark, sf_dir)
    n = s.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.max("start_ns").alias("last_ns")).withColumn("name", F.when(F.col("subject") % 3 == 0, F.concat(F.lit("Customer "), F.col("subject").cast("string"))))
    top = n.where("name is not null").orderBy(F.desc("n"), "name").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name"))).alias("l")).select(F.array_join(F.transform("l", lambda r: r["name"]), ", ").alias("known"))
    rest = n.agg(F.count(F.when(F.col("name").isNull(), 1)).alias("unnamed"), F.max("last_ns").alias("last_ns"))
    return top.join(rest, F.lit(True)).join(s.agg(F.countDistinct("device").alias("devices")), F.lit(True)).select("known", "unnamed", "devices", "last_ns")
