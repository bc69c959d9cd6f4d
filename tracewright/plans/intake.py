"""Intake: manifest checks, metric samples, month partitions, idempotent writes and snapshots of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.scratch import folder, written
from tracewright.operators.stores import drop_months, months_of, read_months, replace_keys, take_in, taken_in, verdicts, with_month, write_months
from tracewright.registry import query
from tracewright.sources.driver_tables import SEGMENTS_SQL, SIGHTINGS_SQL, read, segments, sightings


@query(
    "manifest_checks",
    """WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN md5(CAST(o_orderkey AS VARCHAR))[1:30] ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS uuid, CASE WHEN o_orderkey % 11 = 0 THEN sha256(CAST(o_orderkey AS VARCHAR))[1:62] ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS sha FROM orders)
SELECT id, CASE WHEN length(uuid) <> 32 THEN 'uuid' WHEN length(sha) <> 64 THEN 'sha' WHEN id < 0 THEN 'range' ELSE 'ok' END AS verdict FROM m""",
)
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests whose identifier has 16 bytes and whose digest has 32 are taken in; the first fault is told."""
    key = F.col("o_orderkey").cast("string").cast("binary")
    uuid = F.unhex(F.when(F.col("o_orderkey") % 7 == 0, F.substring(F.md5(key), 1, 30)).otherwise(F.md5(key)))
    sha = F.unhex(F.when(F.col("o_orderkey") % 11 == 0, F.substring(F.sha2(key, 256), 1, 62)).otherwise(F.sha2(key, 256)))
    verdict = F.when(F.octet_length(uuid) != 16, "uuid").when(F.octet_length(sha) != 32, "sha").when(F.col("o_orderkey") < 0, "range").otherwise("ok")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), verdict.alias("verdict"))


def samples(lines: DataFrame) -> DataFrame:
    """``name, labels, value`` of exposition ``lines(line)``; comments and lines without a number are left out."""
    form = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?[ \t]+([0-9.eE+-]+)[ \t]*$"
    part = lambda i: F.regexp_extract("line", form, i)
    return lines.where(F.col("line").rlike(form)).select(part(1).alias("name"), part(2).alias("labels"), part(3).cast("double").alias("value"))


@query(
    "metric_sums",
    f"WITH {SIGHTINGS_SQL} SELECT device, round(sum(value), 2) AS seconds, count(*) AS samples, round(sum(value) / count(*), 4) AS mean FROM s WHERE subject % 2 = 0 GROUP BY device",
)
def metric_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposition lines parsed again: sums by one label where another fits, and the mean."""
    line = F.when(F.col("event_id") % 50 == 0, F.lit("# HELP seen")).otherwise(F.lit(None))
    s = sightings(spark, sf_dir)
    text = F.concat(F.lit('seen_seconds{device="'), "device", F.lit('",half="'), (F.col("subject") % 2).cast("string"), F.lit('"} '), F.col("value").cast("string"))
    lines = s.select(text.alias("line")).unionByName(s.select(line.alias("line")).where("line is not null"))
    m = samples(lines).where(F.col("labels").contains('half="0"')).withColumn("device", F.regexp_extract("labels", 'device="([^"]*)"', 1))
    return m.groupBy("device").agg(F.round(F.sum("value"), 2).alias("seconds"), F.count(F.lit(1)).alias("samples"), F.round(F.sum("value") / F.count(F.lit(1)), 4).alias("mean"))


@query(
    "month_partitions",
    f"WITH {SEGMENTS_SQL} SELECT strftime(make_timestamp(start_ns // 1000), '%Y-%m') AS month, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, strftime(make_timestamp(start_ns // 1000), '%Y-%m') < '1998-03' AS dropped FROM g GROUP BY 1",
)
def month_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of segments written as folders; retention drops the folders of whole months before the cut-off's."""
    path, rows = f"{folder(spark)}/segments", with_month(segments(spark, sf_dir))
    write_months(rows, path)
    months = written(read_months(spark, path, rows.schema).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))
    gone = drop_months(spark, path, "1998-03")
    assert not set(gone) & set(months_of(spark, path))
    return months.withColumn("dropped", F.col("month").isin(gone))


@query(
    "replaced_segments",
    f"WITH {SEGMENTS_SQL}, n AS (SELECT session, sequence, bytes * 2 AS bytes FROM g WHERE session % 5 = 0 AND sequence = 1) SELECT session, sequence, bytes FROM g WHERE session NOT IN (SELECT session FROM n) UNION ALL SELECT * FROM n",
)
def replaced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions processed again, twice over: their stored rows are replaced as a whole."""
    path, rows = f"{folder(spark)}/segments", with_month(segments(spark, sf_dir).select("session", "sequence", "bytes", "start_ns"))
    write_months(rows, path)
    new = rows.where("session % 5 = 0 and sequence = 1").withColumn("bytes", F.col("bytes") * 2)
    replace_keys(new, path, "session")
    replace_keys(new, path, "session")
    return read_months(spark, path, rows.schema).select("session", "sequence", "bytes")


def _uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts as files, and manifests of most of them, some with a wrong length or a wrong digest."""
    n, content = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    name = F.concat(n.cast("string"), F.lit(".txt"))
    d = read(spark, sf_dir, "documents")
    sha = F.when(n % 17 == 0, F.sha2(F.concat(content, F.lit("!").cast("binary")), 256)).otherwise(F.upper(F.sha2(content, 256)))
    told = F.octet_length(content) + F.when(n % 13 == 0, 1).otherwise(0)
    return d.select(name.alias("name"), content.alias("content")), d.where("doc_id % 19 <> 0").select(name.alias("name"), sha.alias("sha256"), told.cast("long").alias("bytes"))


_UPLOADS_SQL = """u AS (SELECT doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS bytes,
  CASE WHEN doc_id % 19 = 0 THEN 'no manifest' WHEN doc_id % 13 = 0 THEN 'length' WHEN doc_id % 17 = 0 THEN 'digest' ELSE 'ok' END AS verdict FROM documents)"""


@query("verified_intake", f"WITH {_UPLOADS_SQL} SELECT name, verdict, sha256, CAST(bytes AS BIGINT) AS bytes FROM u")
def verified_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(*_uploads(spark, sf_dir)).select("name", "verdict", "sha256", "bytes")


@query("content_store", f"WITH {_UPLOADS_SQL} SELECT sha256, CAST(any_value(bytes) AS BIGINT) AS bytes, count(*) AS names, substr(sha256, 1, 2) AS shard FROM u WHERE verdict = 'ok' GROUP BY sha256")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after half of the files have come, then all: each content once, with the number of its names."""
    parts, manifests = _uploads(spark, sf_dir)
    store = f"{folder(spark)}/store"
    take_in(parts.where("length(name) % 2 = 0"), manifests, store)
    take_in(parts, manifests, store)
    names, blobs = taken_in(spark, store)
    return blobs.select("sha256", "bytes", "shard").join(names.where("verdict = 'ok'").groupBy("sha256").agg(F.count(F.lit(1)).alias("names")), "sha256")


@query(
    "observation_snapshot",
    f"WITH {SIGHTINGS_SQL}, {SEGMENTS_SQL}, w AS (SELECT min(start_ns) AS a, min(start_ns) + 864000000000000 AS b FROM s) SELECT 'sightings' AS fact, count(*) AS n, min(start_ns) AS first_ns FROM s, w WHERE start_ns BETWEEN a AND b UNION ALL SELECT 'subjects', count(DISTINCT subject), min(start_ns) FROM s, w WHERE start_ns BETWEEN a AND b UNION ALL SELECT 'segments', count(*), min(start_ns) FROM g, w WHERE start_ns BETWEEN a AND b",
)
def observation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fact table holds of a case's window."""
    s, g = sightings(spark, sf_dir), segments(spark, sf_dir)
    first = s.agg(F.min("start_ns")).first()[0]
    inside = F.col("start_ns").between(first, first + 864_000_000_000_000)
    told = lambda fact, df, n: df.where(inside).agg(n.alias("n"), F.min("start_ns").alias("first_ns")).select(F.lit(fact).alias("fact"), "n", "first_ns")
    every = F.count(F.lit(1))
    return told("sightings", s, every).unionByName(told("subjects", s, F.countDistinct("subject"))).unionByName(told("segments", g, every))
