"""Sentiment of what is said: segment grain, weekly trend, intervals, replies and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import label_of_reply
from tracewright.functions.timeq import SECOND, week_start_day
from tracewright.operators.intervals import number_runs
from tracewright.plans.conversations import _by_conv
from tracewright.registry import query
from tracewright.sources.driver_tables import SIGHTINGS_SQL, TURNS_SQL, sightings, turns

LABELS = ["positive", "neutral", "negative"]
WEEKS, JOINT, SAID = 13, 1_500_000_000, 40 * SECOND
#: Three sentences make a segment; every fourth segment is not classified.
_OF = "CASE {0} % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' END"
_SENTENCES = f"{SIGHTINGS_SQL}, sn AS (SELECT event_id // 3 AS segment, start_ns, {_OF.format('(event_id // 3)')} AS sentiment FROM s), sg AS (SELECT segment, min(sentiment) AS sentiment, count(*) AS sentences, min(start_ns) AS start_ns FROM sn GROUP BY segment)"


def _sentiment(number):
    kind = F.pmod(number, F.lit(4).cast("long"))
    return F.when(kind == 0, "positive").when(kind == 1, "neutral").when(kind == 2, "negative")


def segments_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences carry their segment's sentiment, so they become one row a segment before anything is counted."""
    segment = F.expr("event_id div 3")
    s = sightings(spark, sf_dir).select(segment.alias("segment"), "start_ns", _sentiment(segment).alias("sentiment"))
    return s.groupBy("segment").agg(F.min("sentiment").alias("sentiment"), F.count(F.lit(1)).alias("sentences"), F.min("start_ns").alias("start_ns"))


@query("sentiment_segments", f"WITH {_SENTENCES} SELECT sentiment, count(*) AS segments, CAST(sum(sentences) AS BIGINT) AS sentences FROM sg GROUP BY sentiment")
def sentiment_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of_sentences(spark, sf_dir).groupBy("sentiment").agg(F.count(F.lit(1)).alias("segments"), F.sum("sentences").alias("sentences"))


@query(
    "sentiment_by_week",
    f"""WITH {_SENTENCES}, d AS (SELECT *, start_ns // 86400000000000 AS day FROM sg), w AS (SELECT day - (day + 3) % 7 AS week_start, count(sentiment) AS n, {", ".join(f"count(*) FILTER (WHERE sentiment = '{k}') AS {k}" for k in LABELS)}, count(*) - count(sentiment) AS unclassified FROM d GROUP BY 1)
SELECT *, CASE WHEN n > 0 THEN round(100.0 * positive / n, 4) END AS positive_pct, CASE WHEN n > 0 THEN round(100.0 * negative / n, 4) END AS negative_pct FROM w ORDER BY week_start DESC LIMIT {WEEKS}""",
)
def sentiment_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks from Monday, the newest first to be kept; a week without a classified segment has no shares."""
    s = segments_of_sentences(spark, sf_dir).withColumn("week_start", week_start_day(F.col("start_ns")))
    counts = [F.count(F.when(F.col("sentiment") == k, 1)).alias(k) for k in LABELS]
    w = s.groupBy("week_start").agg(F.count("sentiment").alias("n"), *counts, (F.count(F.lit(1)) - F.count("sentiment")).alias("unclassified"))
    share = lambda k: F.when(F.col("n") > 0, F.round(100.0 * F.col(k) / F.col("n"), 4)).alias(f"{k}_pct")
    return w.select("*", share("positive"), share("negative")).orderBy(F.desc("week_start")).limit(WEEKS)


@query(
    "sentiment_spans",
    f"""WITH {TURNS_SQL}, k AS (SELECT *, {_OF.format('(turn // 3)')} AS sentiment FROM t), f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR sentiment IS DISTINCT FROM lag(sentiment) OVER w OR start_ns - lag(end_ns) OVER w > {JOINT} THEN 1 ELSE 0 END AS isn FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY start_ns, turn)),
r AS (SELECT *, sum(isn) OVER (PARTITION BY conv_id ORDER BY start_ns, turn ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT conv_id, any_value(sentiment) AS sentiment, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS turns FROM r GROUP BY conv_id, run""",
)
def sentiment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one sentiment that follow within a second and a half are one interval."""
    w, t = _by_conv(), turns(spark, sf_dir).withColumn("sentiment", _sentiment(F.expr("turn div 3")))
    new = (F.row_number().over(w) == 1) | ~F.col("sentiment").eqNullSafe(F.lag("sentiment").over(w)) | (F.col("start_ns") - F.lag("end_ns").over(w) > JOINT)
    runs = number_runs(t.withColumn("is_new", new.cast("long")), ["conv_id"], "start_ns", "turn", name="run")
    return runs.groupBy("conv_id", "run").agg(F.first("sentiment").alias("sentiment"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("turns")).drop("run")


@query(
    "sentiment_accuracy",
    f"""WITH {TURNS_SQL}, k AS (SELECT conv_id, {_OF.format('turn')} AS sentiment FROM t WHERE start_ns < {SAID} AND end_ns > 0), c AS (SELECT conv_id, sentiment, count(*) AS n FROM k WHERE sentiment IS NOT NULL GROUP BY ALL),
d AS (SELECT conv_id, arg_max(sentiment, (n, sentiment)) AS dominant FROM c GROUP BY conv_id)
SELECT a.conv_id, dominant, dominant IS NULL AS abstained, coalesce(dominant IN ('positive', 'neutral'), false) AS correct FROM (SELECT DISTINCT conv_id FROM t) a LEFT JOIN d USING (conv_id)""",
)
def sentiment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label in each conversation's first window against the labels that are allowed there."""
    t = turns(spark, sf_dir)
    inside = t.where((F.col("start_ns") < SAID) & (F.col("end_ns") > 0)).withColumn("sentiment", _sentiment(F.col("turn"))).where("sentiment is not null")
    counts = inside.groupBy("conv_id", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("conv_id").agg(F.max_by("sentiment", F.struct("n", "sentiment")).alias("dominant"))
    return t.select("conv_id").distinct().join(best, "conv_id", "left").select("conv_id", "dominant", F.col("dominant").isNull().alias("abstained"), F.coalesce(F.col("dominant").isin("positive", "neutral"), F.lit(False)).alias("correct"))


@query(
    "reply_labels",
    f"""WITH {TURNS_SQL}, k AS (SELECT conv_id, turn, list_filter(['the', 'ion', 'ea'], lambda w: list_contains(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), w)) AS hit FROM t)
SELECT conv_id, turn, CASE WHEN len(hit) = 1 THEN hit[1] END AS label FROM k""",
)
def reply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that a reply names if it names exactly one, as a word."""
    return turns(spark, sf_dir).select("conv_id", "turn", label_of_reply(F.col("text"), ["the", "ion", "ea"]).alias("label"))
