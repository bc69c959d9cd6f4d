"""Gap sessionization, interval unions and interval joins.

Two rows belong together when the gap between them is at most the limit: a gap equal to it does not split.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions.timeq import floor_div


def flag_gaps(df: DataFrame, keys: list[str], start: str, end: str, gap: int, *ties: str, running: bool = False) -> DataFrame:
    """Adds ``is_new``: 1 where a row starts more than ``gap`` after what came before.

    ``running`` compares with the latest end so far instead of the end of the row before."""
    order = W.partitionBy(*keys).orderBy(start, *ties)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)) if running else F.lag(end).over(order)
    return df.withColumn("is_new", (before.isNull() | (F.col(start) - before > gap)).cast("long"))


def number_runs(df: DataFrame, keys: list[str], start: str, *ties: str, flag: str = "is_new", name: str = "run") -> DataFrame:
    return df.withColumn(name, F.sum(flag).over(W.partitionBy(*keys).orderBy(start, *ties).rowsBetween(W.unboundedPreceding, 0)))


def visits_of_points(df: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Visits of points in time: ``keys, visit, start_ns, end_ns, n``. Duplicate instants are one visit's points."""
    flagged = flag_gaps(df, keys, at, at, max(gap, 0))
    numbered = number_runs(flagged, keys, at, name="visit")
    return numbered.groupBy(*keys, "visit").agg(F.min(at).alias("start_ns"), F.max(at).alias("end_ns"), F.count(F.lit(1)).alias("n"))


def visits_of_intervals(df: DataFrame, subject: str, device: str, gap: int, tie: str) -> DataFrame:
    """Visits of a subject over all devices: ``subject, visit, device, start_ns, end_ns, n``.

    A change of device always ends a visit, even within the gap; within a stay at a device the latest end so far counts.
    """
    order = W.partitionBy(subject).orderBy("start_ns", tie)
    moved = df.withColumn("moved", F.coalesce((F.lag(device).over(order) != F.col(device)).cast("long"), F.lit(1)))
    stays = number_runs(moved, [subject], "start_ns", tie, flag="moved", name="stay")
    flagged = flag_gaps(stays, [subject, "stay"], "start_ns", "end_ns", gap, tie, running=True)
    numbered = number_runs(flagged, [subject], "start_ns", tie, name="visit")
    return numbered.groupBy(F.col(subject).alias("subject"), "visit").agg(F.first(device).alias("device"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """The union of ``[start_ns, end_ns)``: touching intervals merge, empty ones are dropped."""
    flagged = flag_gaps(df.where("end_ns > start_ns"), keys, "start_ns", "end_ns", 0, "end_ns", running=True)
    return number_runs(flagged, keys, "start_ns", "end_ns").groupBy(*keys, "run").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("run")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], slack: int, width: int, inclusive: bool = False) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap, each widened by ``slack`` on one side.

    Columns must be ``keys`` and ``a_...`` on one side, ``keys`` and ``b_...`` on the other, with ``a_start, a_end, b_start,
    b_end``. Rows are matched on time buckets of ``width``, so the join is an equi join: an interval is copied to each
    bucket that it touches, and a pair is emitted in the first bucket that both touch, so nothing has to be made distinct.
    ``width`` should be about the length of a long interval.
    """
    first = lambda c: floor_div(c, width)
    a = a.withColumn("bucket", F.explode(F.sequence(first(F.col("a_start") - slack), first(F.col("a_end") + slack))))
    b = b.withColumn("bucket", F.explode(F.sequence(first(F.col("b_start")), first(F.col("b_end")))))
    both = a.join(b, [*keys, "bucket"]).where(F.col("bucket") == F.greatest(first(F.col("a_start") - slack), first(F.col("b_start"))))
    early, late = F.col("a_start") - F.col("b_end"), F.col("b_start") - F.col("a_end")
    return both.where((early <= slack) & (late <= slack) if inclusive else (early < slack) & (late < slack)).drop("bucket")


def band_join(a: DataFrame, b: DataFrame, keys: list[str], band: int) -> DataFrame:
    """Pairs with equal keys whose instants ``a_start`` and ``b_start`` are at most ``band`` apart (inclusive)."""
    a = a.withColumn("bucket", F.explode(F.sequence(floor_div(F.col("a_start") - band, band), floor_div(F.col("a_start") + band, band))))
    b = b.withColumn("bucket", floor_div(F.col("b_start"), band))
    return a.join(b, [*keys, "bucket"]).where(F.abs(F.col("a_start") - F.col("b_start")) <= band).drop("bucket")


#: What a span without an id counts as, so that it comes last.
NO_SPAN = 2**63 - 1


def _chosen(reach: int, earliest: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def found(late: pa.Table, spans: pa.Table) -> pa.Table:
        """Of the spans that hold each instant the first: by its start, or by its id; else the nearest within ``reach``."""
        at, (a, b, span) = np.asarray(late.column("start_ns").combine_chunks()), (np.asarray(spans.column(c).combine_chunks()) for c in ("a", "b", "span"))
        by_start = np.lexsort((span, a))
        ranked = by_start if earliest else np.argsort(span, kind="stable")
        rank = np.empty(len(a), np.int64)
        rank[ranked] = np.arange(len(a))
        ends, starts, ranks = b[ranked].tolist(), a[by_start].tolist(), rank[by_start].tolist()
        open_spans: list[int] = []
        best, n = np.full(len(at), -1), 0
        for i in np.argsort(at, kind="stable").tolist():
            t = int(at[i])
            while n < len(starts) and starts[n] <= t:
                heapq.heappush(open_spans, ranks[n])
                n += 1
            while open_spans and ends[open_spans[0]] < t:
                heapq.heappop(open_spans)
            if open_spans:
                best[i] = ranked[open_spans[0]]
        far = np.zeros(len(at), np.int64)
        if reach and len(a):
            by_end = np.lexsort((-span, b))
            before, after = np.searchsorted(b[by_end], at, "left") - 1, np.searchsorted(a[by_start], at, "right")
            x, y = by_end[np.maximum(before, 0)], by_start[np.minimum(after, len(a) - 1)]
            to_x, to_y = np.where(before >= 0, at - b[x], reach + 1), np.where(after < len(a), a[y] - at, reach + 1)
            first = (to_x < to_y) | ((to_x == to_y) & (span[x] <= span[y]))
            near, away = np.where(first, x, y), np.minimum(to_x, to_y)
            outside = (best < 0) & (away <= reach)
            best[outside], far[outside] = near[outside], away[outside]
        kept = np.flatnonzero(best >= 0)
        return pa.table({"event_id": late.column("event_id").take(pa.array(kept)), "span": pa.array(span[best[kept]]), "a": pa.array(a[best[kept]]), "dist": pa.array(far[kept])})

    return found


def span_of_each(late: DataFrame, spans: DataFrame, cell: int, reach: int = 0, earliest: bool = True) -> DataFrame:
    """``event_id, span, a, dist``: one span of ``spans(device, span, a, b)`` for each row of ``late(event_id, device, start_ns)`` that has one.

    Of those with a <= start_ns <= b it is the first by (a, span), or by span if not ``earliest``; if none holds it, the nearest
    at most ``reach`` away, the smaller id at equal distance. A device's spans are swept once for each time cell of ``cell``,
    with the open ones in a heap, so that no row is paired with the many that hold it."""
    low, high = F.col("a") - reach, F.col("b") + reach
    held = spans.where("a <= b and device is not null").select("device", F.coalesce("span", F.lit(NO_SPAN)).alias("span"), "a", "b", F.explode(F.sequence(floor_div(low, cell), floor_div(high, cell))).alias("cell"))
    asked = late.where("start_ns is not null and device is not null").select("event_id", "device", "start_ns", floor_div(F.col("start_ns"), cell).alias("cell"))
    found = asked.groupBy("device", "cell").cogroup(held.groupBy("device", "cell")).applyInArrow(_chosen(reach, earliest), "event_id long, span long, a long, dist long")
    return found.withColumn("span", F.nullif("span", F.lit(NO_SPAN)))


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{prefix}_{c.removesuffix('_ns')}") for c in df.columns))


def clamped(start: Column, end: Column, lo: int, hi: int) -> Column:
    """The part of an interval within ``[lo, hi)``, at least 0."""
    return F.greatest(F.least(end, F.lit(hi)) - F.greatest(start, F.lit(lo)), F.lit(0).cast("long"))
