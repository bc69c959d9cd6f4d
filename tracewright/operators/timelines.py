"""Timeline and status spans: sequential folds over the segments of one stream and session.

A segment goes on with the span before unless a gap is marked or it starts further from the span's end, on either side,
than it is long. Windows find where a span ends for certain: at a marked gap, or where a row starts further than its
length behind all that went before. What lies between two such breaks is one span if each row starts within its length
of the end so far, and that is settled by windows too. Only runs with a row further off, mostly a step back, are folded row
by row, since the span after it may end before the one in front; many runs go through one call, which holds one end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.folds import folded


def _step(state: tuple[int, int] | None, start: int, length: int) -> tuple[tuple[int, int], int]:
    """The end and number of the span that a row belongs to."""
    if state is None:
        return (start + length, 0), 0
    end, span = state
    if abs(start - end) > length:
        return (start + length, span + 1), span + 1
    return (max(end, start + length), span), span


def _spans(segments: DataFrame, stream: str, session: str, sequence: str, changed: Column, *more: Column) -> DataFrame:
    """Spans and ``more`` aggregates of their rows, numbered by ``place``; a row with ``changed`` begins a span."""
    rows = segments.withColumnsRenamed({stream: "stream", session: "session"})
    order = W.partitionBy("stream", "session").orderBy(sequence, "start_ns")
    end = F.col("start_ns") + F.col("duration_ns")
    behind = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    sure = F.col("gap_before") | changed | behind.isNull() | (F.col("start_ns") - behind > F.col("duration_ns"))
    runs = rows.withColumns({"place": F.row_number().over(order), "sure": sure.cast("long")}).withColumn("run", F.sum("sure").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy("stream", "session", "run")
    inner = F.max(end).over(own.orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    far = F.coalesce(F.abs(F.col("start_ns") - inner) > F.col("duration_ns"), F.lit(False))
    runs = runs.withColumn("far", far).withColumn("folded", F.max("far").over(own)).drop("sure", "far")
    split = folded(runs.where("folded"), ["stream", "session", "run"], ["place"], ["start_ns", "duration_ns"], "span", T.LongType(), _step)
    numbered = runs.where("not folded").withColumn("span", F.lit(0).cast("long")).unionByName(split)
    ends = F.min_by("start_ns", "place").alias("start_ns"), F.max(end).alias("end_ns"), F.count(F.lit(1)).alias("segments")
    return numbered.groupBy("stream", "session", "run", "span").agg(*ends, *more).drop("run", "span")


def timeline_spans(segments: DataFrame, stream: str, session: str, sequence: str) -> DataFrame:
    """Spans of contiguous segments: ``stream, session, start_ns, end_ns, segments``."""
    return _spans(segments.select(stream, session, sequence, "start_ns", "duration_ns", "gap_before"), stream, session, sequence, F.lit(False))


def status_intervals(segments: DataFrame, stream: str, session: str, sequence: str) -> DataFrame:
    """As timeline spans, but a change of status breaks too; ``last_error`` is the latest of the run."""
    kept = segments.select(stream, session, sequence, "start_ns", "duration_ns", "gap_before", "status", "last_error")
    order = W.partitionBy(stream, session).orderBy(sequence, "start_ns")
    kept = kept.withColumn("changed", ~F.col("status").eqNullSafe(F.lag("status").over(order)))
    latest = F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("place")))
    return _spans(kept, stream, session, sequence, F.col("changed"), F.min_by("status", "place").alias("status"), latest.alias("last_error"))
