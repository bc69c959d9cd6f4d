"""Catalogues and their upkeep: edits, rules and acknowledgements, due digests, rebuilt sessions, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions.facade import register
from tracewright.functions.text import CONFUSED, COUNTS_AS
from tracewright.functions.timeq import DAY, MINUTE, civil_day, floor_div, local_second
from tracewright.registry import query
from tracewright.sources.driver_tables import SEGMENTS_SQL, SIGHTINGS_SQL, TURNS_SQL, read, segments, sightings, turns

#: Days of a baseline, and the gap that ends a session.
BASELINE_DAYS, GAP = 30, 20 * MINUTE
#: Local hour from which the day before has its digest, and how far the local clock is ahead.
DIGEST_HOUR, AHEAD_S = 6, 3_600
#: Conversations that a listing shows, and characters of a title.
LISTED, TITLE = 100, 40


@query(
    "baseline_windows",
    f"""WITH {SIGHTINGS_SQL}, k AS (SELECT * FROM s WHERE subject % 4 = 0 AND device <> 'error'), l AS (SELECT subject, max(end_ns) AS latest FROM k GROUP BY subject)
SELECT subject, count(*) AS n, min(start_ns) AS first_ns, max(latest) AS latest_ns FROM k JOIN l USING (subject) WHERE end_ns >= latest - {BASELINE_DAYS * DAY} GROUP BY subject""",
)
def baseline_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The touched subjects' own windows, which end with their latest event; events that the engine raised do not count."""
    k = sightings(spark, sf_dir).where("subject % 4 = 0 and device <> 'error'").select("subject", "start_ns", "end_ns")
    k = k.join(k.groupBy("subject").agg(F.max("end_ns").alias("latest")), "subject").where(F.col("end_ns") >= F.col("latest") - BASELINE_DAYS * DAY)
    return k.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("first_ns"), F.max("latest").alias("latest_ns"))


@query(
    "digests_due",
    f"WITH {SIGHTINGS_SQL}, k AS (SELECT start_ns // 1000000000 + {AHEAD_S} AS t FROM s) SELECT t // 86400 - 1 AS digest_day, min(t) AS made_at_s, count(*) AS asked FROM k WHERE (t % 86400) // 3600 >= {DIGEST_HOUR} GROUP BY 1",
)
def digests_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for the digest of the local day before: it waits for the hour and is made once, at the first asking."""
    t = sightings(spark, sf_dir).select(local_second(F.col("start_ns"), AHEAD_S).alias("t")).where(floor_div(F.pmod("t", F.lit(86_400).cast("long")), 3_600) >= DIGEST_HOUR)
    return t.groupBy((floor_div(F.col("t"), 86_400) - 1).alias("digest_day")).agg(F.min("t").alias("made_at_s"), F.count(F.lit(1)).alias("asked"))


def rebuilt(points: DataFrame, key: str, gap: int) -> DataFrame:
    """``points(key, start_ns)`` with ``day`` and whether each is the ``first`` of a session, by chunks of a key's day.

    A chunk also holds what lies within one ``gap`` (at most a day) before it, so that a day can be rebuilt alone and gives
    the same firsts as the whole history."""
    day = civil_day(F.col("start_ns"))
    chunks = points.withColumn("day", day).withColumn("chunk", F.explode(F.array_distinct(F.array(day, civil_day(F.col("start_ns") + gap)))))
    last = F.lag("start_ns").over(W.partitionBy(key, "chunk").orderBy("start_ns"))
    return chunks.withColumn("first", last.isNull() | (F.col("start_ns") - last > gap)).where("day = chunk").drop("chunk")


@query(
    "rebuilt_sessions",
    f"""WITH {SIGHTINGS_SQL}, f AS (SELECT device, start_ns // {DAY} AS day, CASE WHEN start_ns - lag(start_ns) OVER (PARTITION BY device ORDER BY start_ns) <= {GAP} THEN 0 ELSE 1 END AS first FROM s)
SELECT device, day, CAST(sum(first) AS BIGINT) AS sessions, count(*) AS n FROM f GROUP BY device, day""",
)
def rebuilt_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that begin on a device's day, refolded day by day."""
    f = rebuilt(sightings(spark, sf_dir).select("device", "start_ns"), "device", GAP)
    return f.groupBy("device", "day").agg(F.sum(F.col("first").cast("long")).alias("sessions"), F.count(F.lit(1)).alias("n"))


@query(
    "catalog_edits",
    """WITH e AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderdate AS t, o_orderkey % 4 AS kind FROM orders),
c AS (SELECT id, count(*) AS edits, arg_max(k, (t, k)) FILTER (WHERE kind = 0) AS named, arg_max(k, (t, k)) FILTER (WHERE kind = 1) AS kept FROM e GROUP BY id)
SELECT c_custkey AS id, CASE WHEN named IS NULL THEN c_name ELSE 'renamed ' || named END AS name, coalesce(kept % 8 = 1, false) AS archived,
  c_custkey = (SELECT arg_max(id, (t, k)) FROM e WHERE kind = 2) AS is_owner, coalesce(edits, 0) AS edits FROM customer LEFT JOIN c ON id = c_custkey""",
)
def catalog_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue after its edits: the last name given, the last word on archiving, and one owner, the last that was claimed."""
    e = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"), (F.col("o_orderkey") % 4).alias("kind"))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("t", "k")))["k"]
    c = e.groupBy("id").agg(F.count(F.lit(1)).alias("edits"), last(0).alias("named"), last(1).alias("kept"))
    owner = e.where("kind = 2").agg(F.max(F.struct("t", "k", "id"))["id"].alias("id")).withColumn("is_owner", F.lit(True))
    all_ = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name").join(c, "id", "left").join(F.broadcast(owner), "id", "left")
    name = F.when(F.col("named").isNull(), F.col("c_name")).otherwise(F.concat(F.lit("renamed "), F.col("named").cast("string")))
    return all_.select("id", name.alias("name"), F.coalesce(F.col("kept") % 8 == 1, F.lit(False)).alias("archived"), F.coalesce("is_owner", F.lit(False)).alias("is_owner"), F.coalesce("edits", F.lit(0)).alias("edits"))


def rule_fault(name, severity, first, last, days, cooldown, channels):
    """The first fault of a rule's draft, or null; ``channels`` are structs of a kind and a url."""
    outside = lambda m: m.isNotNull() & ~m.between(0, 1439)
    bad_hook = F.exists(channels, lambda c: (c["kind"] == "webhook") & ~F.coalesce(c["url"], F.lit("")).rlike("^https?://"))
    return (
        F.when(F.trim(name) == "", "name").when(~severity.isin("info", "warning", "critical"), "severity").when(outside(first) | outside(last), "minutes")
        .when(first.isNull() != last.isNull(), "one end").when(first == last, "no width").when(F.exists(days, lambda d: ~d.between(0, 6)), "days").when(cooldown < 0, "cooldown")
        .when(F.exists(channels, lambda c: ~c["kind"].isin("feed", "push", "webhook")), "channel").when(bad_hook, "url")
    )


@query(
    "rule_drafts",
    """WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE 'rule' END AS name, ['info', 'warning', 'critical', 'loud'][CAST(o_custkey % 16 AS INTEGER) // 5 + 1] AS severity,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 7 % 1500 - 10 END AS a, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 11 > 0 THEN o_custkey % 3 * 500 + 1 END AS b,
  o_orderkey % 8 AS day, o_custkey % 12 - 1 AS cooldown, ['feed', 'push', 'webhook', 'fax'][CAST(o_orderkey % 13 AS INTEGER) // 4 + 1] AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'ftp://x' ELSE 'https://x' END AS url FROM orders)
SELECT id, CASE WHEN trim(name) = '' THEN 'name' WHEN severity = 'loud' THEN 'severity' WHEN a NOT BETWEEN 0 AND 1439 OR b NOT BETWEEN 0 AND 1439 THEN 'minutes' WHEN (a IS NULL) <> (b IS NULL) THEN 'one end'
  WHEN a = b THEN 'no width' WHEN day > 6 THEN 'days' WHEN cooldown < 0 THEN 'cooldown' WHEN kind = 'fax' THEN 'channel' WHEN kind = 'webhook' AND url NOT LIKE 'http%' THEN 'url' END AS fault FROM d""",
)
def rule_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of alert rules and what is wrong with each first."""
    o, k, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    name, severity = F.when(k % 17 == 0, "  ").otherwise("rule"), of(["info", "warning", "critical", "loud"], floor_div(c % 16, 5))
    first, last = F.when(k % 5 > 0, k * 7 % 1500 - 10), F.when((k % 5 > 0) & (k % 11 > 0), c % 3 * 500 + 1)
    channel = F.struct(of(["feed", "push", "webhook", "fax"], floor_div(k % 13, 4)).alias("kind"), F.when(k % 3 == 0, "ftp://x").otherwise("https://x").alias("url"))
    return o.select(k.alias("id"), rule_fault(name, severity, first, last, F.array(k % 8), c % 12 - 1, F.array(channel)).alias("fault"))


@query(
    "acknowledgements",
    """WITH a AS (SELECT l_orderkey * CASE WHEN l_partkey % 10 = 0 THEN -1 ELSE 1 END AS id, l_shipdate AS t FROM lineitem WHERE l_linenumber = 3), f AS (SELECT id, max(t) AS t FROM a GROUP BY id)
SELECT coalesce(o_orderkey, f.id) AS id, CASE WHEN o_orderkey IS NULL THEN 'not found' WHEN f.id IS NULL THEN 'pending' ELSE 'acknowledged' END AS status, f.t AS acknowledged_at FROM orders FULL JOIN f ON f.id = o_orderkey""",
)
def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries after their acknowledgements, the last of which counts; those of unknown deliveries are told."""
    key = F.col("l_orderkey") * F.when(F.col("l_partkey") % 10 == 0, -1).otherwise(1)
    f = read(spark, sf_dir, "lineitem").where("l_linenumber = 3").groupBy(key.alias("id")).agg(F.max("l_shipdate").alias("acknowledged_at"), F.lit(1).alias("asked"))
    both = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("known")).join(f, "id", "full")
    return both.select("id", F.when(F.col("known").isNull(), "not found").when(F.col("asked").isNull(), "pending").otherwise("acknowledged").alias("status"), "acknowledged_at")


@query(
    "subject_refresh",
    f"WITH {SIGHTINGS_SQL}, d AS (SELECT device, count(*) AS n, min(start_ns) AS a, max(end_ns) AS b FROM s WHERE subject = 7 GROUP BY device) SELECT CAST(sum(n) AS BIGINT) AS n, min(a) AS first_ns, max(b) AS last_ns, arg_min(device, (-n, device)) AS mostly FROM d HAVING count(*) > 0",
)
def subject_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subject's profile folded on demand; the subject's filter reaches the scan, and devices are counted before they meet."""
    d = sightings(spark, sf_dir).where("subject = 7").groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("a"), F.max("end_ns").alias("b"))
    return d.agg(F.sum("n").alias("n"), F.min("a").alias("first_ns"), F.max("b").alias("last_ns"), F.min(F.struct((-F.col("n")).alias("n"), "device"))["device"].alias("mostly")).where("n is not null")


@query(
    "chapters_of_book",
    "SELECT source AS book, doc_id AS chapter, array_extract(string_split(text, chr(10)), 1) AS first_chunk, CAST(len(string_split(text, chr(10))) AS BIGINT) AS chunks FROM documents WHERE source = (SELECT min(source) FROM documents)",
)
def chapters_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of the first book, with their first chunks and how many they have."""
    d, parts = read(spark, sf_dir, "documents"), F.split("text", "\n")
    book = d.agg(F.min("source").alias("source"))
    return d.join(F.broadcast(book), "source", "left_semi").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), parts[0].alias("first_chunk"), F.size(parts).cast("long").alias("chunks"))


@query(
    "session_listing",
    f"""WITH {TURNS_SQL} SELECT conv_id, count(*) AS messages, max(end_ns) AS last_ns, substr(arg_min(text, turn) FILTER (WHERE speaker = 'user' AND text IS NOT NULL), 1, {TITLE}) AS title
FROM t GROUP BY conv_id ORDER BY last_ns DESC, conv_id LIMIT {LISTED}""",
)
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest conversations, each by the beginning of its first question."""
    title = F.min(F.when((F.col("speaker") == "user") & F.col("text").isNotNull(), F.struct("turn", F.substring("text", 1, TITLE).alias("title"))))["title"]
    c = turns(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("end_ns").alias("last_ns"), title.alias("title"))
    return c.orderBy(F.desc("last_ns"), "conv_id").limit(LISTED)


@query(
    "sql_functions",
    f"""WITH {SEGMENTS_SQL}, m AS (SELECT part, min(strftime(make_timestamp(start_ns // 1000), '%Y-%m')) AS first_month FROM g GROUP BY part)
SELECT p_partkey AS part, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS plate, translate(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), '{CONFUSED}', '{COUNTS_AS}') AS folded,
  round(1 - (3.0 * p_size + 4 * p_partkey) / (5 * sqrt(CAST(p_size AS DOUBLE) * p_size + CAST(p_partkey AS DOUBLE) * p_partkey)), 6) AS distance, first_month FROM part LEFT JOIN m ON part = p_partkey WHERE p_size > 0""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions as SQL knows them."""
    register(spark)
    month = F.call_function("month_of", F.col("start_ns"))
    m = segments(spark, sf_dir).groupBy("part").agg(F.min(month).alias("first_month"))
    p = read(spark, sf_dir, "part").where("p_size > 0").selectExpr(
        "p_partkey AS part", "plate_key(p_brand) AS plate", "fold_confusables(plate_key(p_brand)) AS folded",
        "round(cosine_distance(array(double(p_size), double(p_partkey)), array(3D, 4D)), 6) AS distance",
    )
    return p.join(m, "part", "left")
