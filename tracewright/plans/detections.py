"""Detections: frames, folds per segment, boxes, quality ladders, hints and load levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.timeq import SECOND
from tracewright.operators.vectors import doubles
from tracewright.registry import query
from tracewright.sources.driver_tables import SEGMENTS_SQL, SIGHTINGS_SQL, read, segments, sightings

OVERLAP, CALM = 0.5, 3

#: A part is a box of a frame: its place and size come from its key, its score from its price.
_BOX = """bx AS (SELECT l_orderkey AS frame, l_linenumber AS box, (l_partkey * 7) % 40 AS x, (l_suppkey * 5) % 30 AS y, 10 + l_partkey % 25 AS w, 10 + l_suppkey % 20 AS h, l_extendedprice AS score FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("frame"), c("l_linenumber").alias("box"), ((c("l_partkey") * 7) % 40).alias("x"), ((c("l_suppkey") * 5) % 30).alias("y"),
        (10 + c("l_partkey") % 25).alias("w"), (10 + c("l_suppkey") % 20).alias("h"), c("l_extendedprice").alias("score"),
    )


def iou(p: str, q: str):
    """Intersection over union of two boxes whose columns begin with ``p`` and ``q``."""
    side = lambda at, size: F.greatest(F.lit(0), F.least(F.col(p + at) + F.col(p + size), F.col(q + at) + F.col(q + size)) - F.greatest(p + at, q + at))
    inter = side("x", "w") * side("y", "h")
    return inter / (F.col(p + "w") * F.col(p + "h") + F.col(q + "w") * F.col(q + "h") - inter)


@query(
    "box_overlaps",
    f"""WITH {_BOX}, p AS (SELECT a.frame, a.box AS a, b.box AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS u FROM bx a JOIN bx b ON a.frame = b.frame AND a.box < b.box)
SELECT frame, a, b, round(i / (u - i), 6) AS iou FROM p WHERE i > 0""",
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    side = lambda s: b.select("frame", *(F.col(c).alias(s + c) for c in ("box", "x", "y", "w", "h")))
    pairs = side("a_").join(side("b_"), "frame").where("a_box < b_box").withColumn("iou", iou("a_", "b_")).where("iou > 0")
    return pairs.select("frame", F.col("a_box").alias("a"), F.col("b_box").alias("b"), F.round("iou", 6).alias("iou"))


def _suppressed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``frame, found`` whose boxes come best first: each is kept unless it overlaps a kept one by more than OVERLAP."""
    for batch in batches:
        out = []
        for frame, found in zip(batch["frame"], batch["found"], strict=True):
            kept: list[dict] = []
            for r in found:
                wide = lambda k, r=r: max(0, min(r["x"] + r["w"], k["x"] + k["w"]) - max(r["x"], k["x"])) * max(0, min(r["y"] + r["h"], k["y"] + k["h"]) - max(r["y"], k["y"]))
                if all((i := wide(k)) <= OVERLAP * (r["w"] * r["h"] + k["w"] * k["h"] - i) for k in kept):
                    kept.append(r)
            out += [(frame, r["box"]) for r in kept]
        yield pd.DataFrame(out, columns=["frame", "box"])


@query("best_boxes")
def best_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression of overlapping boxes in each frame, by score; a frame holds a camera's few detections."""
    one = F.struct((-F.col("score")).alias("s"), "box", "x", "y", "w", "h")
    frames = boxes(spark, sf_dir).groupBy("frame").agg(F.array_sort(F.collect_list(one)).alias("found"))
    return frames.mapInPandas(_suppressed, "frame long, box long")


@query(
    "segment_detections",
    f"WITH {SIGHTINGS_SQL} SELECT event_id // 20 AS segment, subject, min(start_ns) AS start_ns, max(end_ns) AS end_ns, max(value) AS score, count(*) AS n FROM s GROUP BY ALL",
)
def segment_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each segment's detections say of each subject."""
    return sightings(spark, sf_dir).groupBy(F.expr("event_id div 20").alias("segment"), "subject").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.max("value").alias("score"), F.count(F.lit(1)).alias("n"))


_FRAMES = f"""{SEGMENTS_SQL}, d AS (SELECT session, sequence, start_ns + coalesce(CASE WHEN part % 4 <> 0 THEN part * 1000000 END, 0) AS at_ns,
  coalesce(CASE WHEN part % 3 = 0 THEN 'name' || device END, CASE WHEN part % 5 = 0 THEN 'plate' || part END, CASE WHEN part % 7 = 0 THEN 'text' || sequence END) AS label, CASE media_type WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'muxed' ELSE 'other' END AS kind FROM g)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with their absolute instant, the first label that is known, and the media's kind by name."""
    part = F.col("part")
    text = lambda word, c: F.concat(F.lit(word), F.col(c).cast("string"))
    label = F.coalesce(F.when(part % 3 == 0, text("name", "device")), F.when(part % 5 == 0, text("plate", "part")), F.when(part % 7 == 0, text("text", "sequence")))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in (1, "audio", 2, "video", 3, "muxed"))), F.col("media_type")), F.lit("other"))
    return segments(spark, sf_dir).select("session", "sequence", (F.col("start_ns") + F.coalesce(F.when(part % 4 != 0, part * 1_000_000), F.lit(0))).alias("at_ns"), label.alias("label"), kind.alias("kind"))


@query("detection_instants", f"WITH {_FRAMES} SELECT * FROM d")
def detection_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir)


@query("frames", f"WITH {_FRAMES} SELECT session, at_ns, count(*) AS n, string_agg(kind || ':' || coalesce(label, '-'), ',' ORDER BY kind, coalesce(label, '-')) AS shown FROM d GROUP BY session, at_ns")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections of all lanes at one instant as one frame."""
    shown = F.concat_ws(":", "kind", F.coalesce("label", F.lit("-")))
    return _frames(spark, sf_dir).groupBy("session", "at_ns").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("shown"))


@query("frames_cut", f"WITH {_FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY at_ns, sequence) AS k, count(*) OVER (PARTITION BY session) AS held FROM d) SELECT session, sequence, at_ns, held > 3 AS truncated FROM n WHERE k <= 3")
def frames_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three detections of a session, and whether there were more."""
    w = W.partitionBy("session")
    cut = _frames(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy("at_ns", "sequence")), "held": F.count(F.lit(1)).over(w)})
    return cut.where("k <= 3").select("session", "sequence", "at_ns", (F.col("held") > 3).alias("truncated"))


@query(
    "hint_gate",
    f"""WITH {SIGHTINGS_SQL}, h AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN value / 100 END, value / 200) END AS rms, event_id % 100 AS roll FROM s)
SELECT event_id, CASE WHEN rms IS NULL OR rms > 0.5 THEN 'enqueue' WHEN roll < 5 THEN 'audit' ELSE 'skip' END AS decision FROM h""",
)
def hint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud segments are worked on, a few quiet ones audited; one without a hint is worked on."""
    rms = F.when(F.col("event_id") % 6 != 0, F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("value") / 100), F.col("value") / 200))
    decision = F.when(rms.isNull() | (rms > 0.5), "enqueue").when(F.col("event_id") % 100 < 5, "audit").otherwise("skip")
    return sightings(spark, sf_dir).select("event_id", decision.alias("decision"))


#: Gates of faces (detector score, smaller side, sharpness) and of plates (detector score, reading confidence and that for a new plate, side, signs).
FACE_GATES, PLATE_GATES = (0.2, 13.0, 8.0), (0.1, 0.3, 0.7, 12.0, 4)


def face_quality(score, side, sharpness, gates=FACE_GATES):
    """A face below a gate is rejected; one well above all of them may found an identity, the rest may only be attached."""
    least_score, least_side, least_sharp = gates
    sure = (score >= min(least_score + 0.2, 0.95)) & (side >= least_side * 1.5) & (sharpness >= least_sharp * 1.5)
    return F.when((score < least_score) | (side < least_side) | (sharpness < least_sharp), "reject").when(sure, "mint").otherwise("attach_only")


def plate_quality(score, confidence, side, signs, gates=PLATE_GATES):
    """A read below a gate is rejected; one that is read with confidence may found a plate, the rest may only be attached."""
    least_score, least_read, sure_read, least_side, least_signs = gates
    poor = (score < least_score) | (confidence < least_read) | (side < least_side) | (signs < least_signs)
    return F.when(poor, "reject").when(confidence >= sure_read, "mint").otherwise("attach_only")


@query(
    "detection_quality",
    f"""WITH {_BOX}, q AS (SELECT frame, box, score / 100000 AS score, least(w, h) AS side, (w * h) % 37 AS sharp, frame * 7 % 10 / 10 AS conf, frame % 9 AS signs FROM bx)
SELECT frame, box, CASE WHEN score < 0.2 OR side < 13 OR sharp < 8 THEN 'reject' WHEN score >= 0.4 AND side >= 19.5 AND sharp >= 12 THEN 'mint' ELSE 'attach_only' END AS face,
  CASE WHEN score < 0.1 OR conf < 0.3 OR side < 12 OR signs < 4 THEN 'reject' WHEN conf >= 0.7 THEN 'mint' ELSE 'attach_only' END AS plate FROM q""",
)
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box by both ladders."""
    score, side, sharp = F.col("score") / 100_000, F.least("w", "h"), (F.col("w") * F.col("h")) % 37
    plate = plate_quality(score, F.col("frame") * 7 % 10 / 10, side, F.col("frame") % 9)
    return boxes(spark, sf_dir).select("frame", "box", face_quality(score, side, sharp).alias("face"), plate.alias("plate"))


@query(
    "motion_distance",
    """WITH e AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(embedding)) AS a, list_transform(p, lambda x: CAST(x AS DOUBLE) - list_avg(p)) AS b FROM e WHERE p IS NOT NULL)
SELECT vec_id, round(list_avg(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM d""",
)
def motion_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a camera's tile differs from the one before: the mean square of their differences from their means; the
    greatest number there is for tiles of different sizes."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("a"))
    e = e.withColumn("b", F.lag("a").over(W.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    e = e.withColumns({"ma": total(F.col("a")) / F.size("a"), "mb": total(F.col("b")) / F.size("b")})
    square = F.zip_with("a", "b", lambda x, y: ((x - F.col("ma")) - (y - F.col("mb"))) * ((x - F.col("ma")) - (y - F.col("mb"))))
    return e.select("vec_id", F.round(F.when(F.size("a") != F.size("b"), F.lit(float(np.finfo(float).max))).otherwise(total(square) / F.size("a")), 6).alias("distance"))


@query("load_levels")
def load_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load level of each subject's day, hour by hour: up at once, down one level after CALM calmer ticks.

    A day's ticks are at most 24, so the fold over them is bounded."""
    s = sightings(spark, sf_dir)
    hour = F.expr(f"start_ns div {3600 * SECOND}")
    ticks = s.groupBy("device", F.expr(f"start_ns div {86_400 * SECOND}").alias("day"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    target = F.when(F.col("n") >= 4, 2).when(F.col("n") >= 2, 1).otherwise(0)
    days = ticks.groupBy("device", "day").agg(F.array_sort(F.collect_list(F.struct("hour", target.alias("target")))).alias("ticks"))
    begun = F.struct(F.lit(0).alias("level"), F.lit(0).alias("calm"), F.expr("cast(array() as array<struct<hour: bigint, level: int>>)").alias("out"))

    def step(acc, t):
        up = t["target"] >= acc["level"]
        calm = F.when(up, 0).otherwise(acc["calm"] + 1)
        down = calm >= CALM
        level = F.when(up, t["target"]).when(down, acc["level"] - 1).otherwise(acc["level"])
        return F.struct(level.alias("level"), F.when(down, 0).otherwise(calm).alias("calm"), F.array_append(acc["out"], F.struct(t["hour"].alias("hour"), level.alias("level"))).alias("out"))

    return days.select("device", F.explode(F.aggregate("ticks", begun, step, lambda acc: acc["out"])).alias("o")).select("device", "o.hour", "o.level")
