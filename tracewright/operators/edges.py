"""Edges of the entity graph as states that can be merged: counts, spans, the newest evidence, and metadata by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["kind", "src", "dst"]
#: Samples of evidence that an edge keeps, a fixed value.
EVIDENCE = 16


def observed(rows: DataFrame, kind: Column, src: Column, dst: Column, event: Column, start: Column, end: Column, confidence: Column, metadata: Column) -> DataFrame:
    """Each row as the state of an edge that was seen once. Null confidences and null metadata values say nothing."""
    at = lambda value: F.struct(start.cast("long").alias("at"), event.cast("long").alias("event"), value.alias("value"))
    return rows.select(
        kind.alias("kind"), src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(1).cast("long").alias("n"), start.cast("long").alias("first_ns"), end.cast("long").alias("last_ns"),
        F.array(F.struct(start.cast("long").alias("at"), event.cast("long").alias("event"))).alias("evidence"), F.when(confidence.isNotNull(), at(confidence.cast("double"))).alias("confidence"),
        F.transform_values(F.map_filter(metadata, lambda _, v: v.isNotNull()), lambda _, v: at(v)).alias("metadata"),
    )


def merged_edges(states: DataFrame) -> DataFrame:
    """One state for each edge of ``states``. Merging merged states gives what merging all at once gives, in any grouping.

    Counts add up, spans are joined, the newest 16 different samples stay (of one time the smaller event first), and the
    confidence and each key of the metadata are the newest that were given. An edge to itself is dropped. Every part is
    cut or summed before the shuffle, so an edge that is seen all the time costs a task no more than another."""
    states = states.where("src <> dst")
    sums = states.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.max("confidence").alias("confidence"))
    samples = states.select(*KEYS, F.explode("evidence").alias("s")).distinct()
    newest = samples.withColumn("k", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("s.at"), "s.event"))).where(F.col("k") <= EVIDENCE)
    evidence = newest.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("evidence"))
    entries = states.select(*KEYS, F.explode("metadata").alias("key", "value")).groupBy(*KEYS, "key").agg(F.max("value").alias("value"))
    metadata = entries.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    made = sums.join(evidence, KEYS).join(metadata, KEYS, "left")
    return made.select(*KEYS, "n", "first_ns", "last_ns", "evidence", "confidence", F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{entries.schema['value'].dataType.simpleString()}>"))).alias("metadata"))


def renamed(states: DataFrame, names: DataFrame) -> DataFrame:
    """States whose ends follow ``names(id, survivor)``; merge them again to fold edges that fall together."""
    out = states
    for end in ("src", "dst"):
        out = out.join(names.select(F.col("id").alias(end), F.col("survivor").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return out.select(*states.columns)
