"""Conversation disentanglement: which sentences of a device's stream belong to one conversation, under which lasting id.

Sentences are merged to utterances, utterances to blocks by silence. Within a block speakers are tied by replies and by
likeness of topic; if the tied groups pass the split gate each is a conversation, else the block is one. Utterances
of unknown speakers join the group that suits them, and a conversation keeps the id that most of its sentences had before.

Everything is windows, joins and sums over the utterances, also the likeness of two groups: with unit vectors
the similarities of all pairs add up to the product of the groups' sums. Only the unknown speakers of blocks that were
split are folded in order of time, since each one that joins a group moves its centre for the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.timeq import SECOND
from tracewright.operators.graphs import components
from tracewright.operators.intervals import flag_gaps, number_runs
from tracewright.operators.scratch import settled, shuffled, written
from tracewright.operators.vectors import dot, doubles, normalized, vector_sums


@dataclass(frozen=True)
class Threading:
    """Fixed values of the rules: gaps in nanoseconds, similarities as cosines."""

    block_gap: int = 300 * SECOND
    merge_gap: int = SECOND
    reply_gap: int = 5 * SECOND
    reply_like: float = 0.45
    reply: float = 1.0
    stray: float = 0.25
    attract: float = 0.60
    repel: float = 0.35
    topic: float = 2.0
    tie: float = 2.0
    least_utterances: int = 4
    most_alike: float = 0.40
    by_topic_alone: bool = False


def _likeness(a: Column, b: Column) -> Column:
    """The product of two unit vectors; null where one is missing, empty or of another length."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b))


def _utterances(sentences: DataFrame, rules: Threading) -> tuple[DataFrame, DataFrame]:
    """The sentences with their ``utterance``, and the utterances with their ``block``; both are numbered by device."""
    order = W.partitionBy("device").orderBy("start_ns", "id")
    moved = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) | (F.row_number().over(order) == 1)
    stays = number_runs(sentences.withColumn("moved", moved.cast("long")), ["device"], "start_ns", "id", flag="moved", name="stay")
    merged = number_runs(flag_gaps(stays, ["device", "stay"], "start_ns", "end_ns", rules.merge_gap, "id", running=True), ["device"], "start_ns", "id", name="utterance")
    merged = written(merged.drop("moved", "stay", "is_new"))
    spans = merged.groupBy("device", "utterance").agg(F.first("speaker").alias("speaker"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    blocks = number_runs(flag_gaps(spans, ["device"], "start_ns", "end_ns", rules.block_gap, "utterance"), ["device"], "start_ns", "utterance", name="block").drop("is_new")
    means = vector_sums(merged, ["device", "utterance"], "embedding").select("device", "utterance", normalized(F.col("total")).alias("vec"))
    return merged, written(blocks.join(shuffled(means), ["device", "utterance"], "left"))


def _ties(u: DataFrame, rules: Threading) -> DataFrame:
    """``device, block, a, b`` of two speakers who are in conversation."""
    order = W.partitionBy("device", "block").orderBy("utterance")
    before = {f"p_{c}": F.lag(c).over(order) for c in ("speaker", "end_ns", "vec")}
    replies = u.withColumns(before).where("speaker <> p_speaker").where(F.col("start_ns") - F.col("p_end_ns") <= rules.reply_gap)
    strength = F.when(_likeness(F.col("vec"), F.col("p_vec")) >= rules.reply_like, rules.reply).otherwise(rules.stray)
    replies = replies.select("device", "block", F.least("speaker", "p_speaker").alias("a"), F.greatest("speaker", "p_speaker").alias("b"), strength.alias("weight"))
    said = written(vector_sums(u.where("speaker is not null"), ["device", "block", "speaker"], "vec"))
    a, b = (said.select("device", "block", F.col("speaker").alias(k), F.col("n").alias(f"n_{k}"), F.col("total").alias(f"total_{k}")) for k in "ab")
    mean = _likeness(F.col("total_a"), F.col("total_b")) / (F.col("n_a") * F.col("n_b"))
    bonus = F.when(mean >= rules.attract, rules.topic).when(mean <= rules.repel, -rules.topic).otherwise(0.0)
    topics = a.join(shuffled(b), ["device", "block"]).where("a < b").select("device", "block", "a", "b", bonus.alias("weight"))
    weights = replies.unionByName(topics).groupBy("device", "block", "a", "b").agg(F.sum("weight").alias("weight"))
    return weights.where(F.col("weight") >= rules.tie).drop("weight")


def _groups(u: DataFrame, ties: DataFrame) -> DataFrame:
    """The utterances of known speakers with their ``group``, the number of its first utterance."""
    name = lambda c: F.to_json(F.struct("device", "block", F.col(c)).cast("struct<d: string, b: string, s: string>"))
    linked = components(ties.select(name("a").alias("a"), name("b").alias("b"))).select(F.col("id").alias("who"), "component")
    known = u.where("speaker is not null").withColumn("who", name("speaker"))
    known = known.join(shuffled(linked), "who", "left").withColumn("component", F.coalesce("component", "who"))
    return known.withColumn("group", F.min("utterance").over(W.partitionBy("component"))).drop("who", "component")


def _split_blocks(known: DataFrame, rules: Threading) -> DataFrame:
    """The groups of the blocks that pass the gate: ``device, block, group, n, total``.

    A group must have enough utterances, its span overlap that of every other group, and the mean similarity of utterances
    of different groups be low enough."""
    spans = known.groupBy("device", "block", "group").agg(F.count(F.lit(1)).alias("size"), F.min("start_ns").alias("lo"), F.max("end_ns").alias("hi"))
    sums = vector_sums(known, ["device", "block", "group"], "vec")
    groups = written(spans.join(shuffled(sums), ["device", "block", "group"], "left"))
    order = W.partitionBy("device", "block").orderBy("group")
    others = F.greatest(F.max("lo").over(order.rowsBetween(W.unboundedPreceding, -1)), F.max("lo").over(order.rowsBetween(1, W.unboundedFollowing)))
    apart = F.lit(rules.by_topic_alone) | (others < F.col("hi"))
    by = W.partitionBy("device", "block")
    fits = groups.withColumns({"groups": F.count(F.lit(1)).over(by), "ok": F.min(((F.col("size") >= rules.least_utterances) & apart).cast("int")).over(by)}).where("groups > 1 and ok = 1")
    # Similarities of all pairs of a block less those within its groups, each pair once.
    square = F.coalesce(dot(F.col("total"), F.col("total")), F.lit(0.0))
    inner = fits.groupBy("device", "block").agg(F.sum(square).alias("within"), F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("n")).alias("within_n"))
    blocks = vector_sums(known.join(shuffled(fits.select("device", "block").distinct()), ["device", "block"]), ["device", "block"], "vec").select("device", "block", F.col("total").alias("block_total"))
    inner = inner.join(shuffled(blocks), ["device", "block"], "left")
    pairs = F.coalesce((F.col("all_n") * F.col("all_n") - F.col("within_n")) / 2, F.lit(0.0))
    cross = (dot(F.col("block_total"), F.col("block_total")) - F.col("within")) / 2
    passed = inner.where((pairs == 0) | (cross / pairs <= rules.most_alike)).select("device", "block")
    return fits.join(shuffled(passed), ["device", "block"]).select("device", "block", "group", "n", "total")


def _joined(key: tuple, orphans: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Each unknown utterance with the group of the highest 0.6 * topic + 0.4 / (1 + gap in seconds), the earlier group at ties.

    ``gaps`` are to the groups' own members, in the order of the groups; those who have joined before count as members too."""
    groups = groups.sort_values("group")
    n = groups["n"].fillna(0).to_numpy(float)
    length = max([len(t) for t in groups["total"] if t is not None], default=0)
    total = np.array([t if t is not None and len(t) == length else [0.0] * length for t in groups["total"]]).reshape(len(groups), length)
    ends, out = np.full(len(groups), -np.inf), []
    for o in orphans.sort_values("utterance").itertuples(index=False):
        vec = np.asarray(o.vec, float) if o.vec is not None and len(o.vec) == length and length else None
        norm = np.linalg.norm(total, axis=1) if length else np.zeros(len(groups))
        topic = np.where((n > 0) & (norm > 0), total @ vec / np.where(norm > 0, norm, 1), 0.0) if vec is not None else 0.0
        gap = np.minimum(np.asarray(o.gaps, float), np.maximum(0.0, o.start_ns - ends)) / SECOND
        best = int(np.argmax(0.6 * topic + 0.4 / (1 + gap)))
        out.append((o.device, o.utterance, groups["group"].iloc[best]))
        ends[best] = max(ends[best], o.end_ns)
        if vec is not None:
            total[best] += vec
            n[best] += 1
    return pd.DataFrame(out, columns=["device", "utterance", "group"])


def _orphans(u: DataFrame, known: DataFrame, split: DataFrame, device_type: str) -> DataFrame:
    """``device, utterance, group`` of the unknown speakers' utterances in split blocks."""
    names = shuffled(split.select("device", "block", "group"))
    lost = u.where("speaker is null").join(names, ["device", "block"]).withColumn("lost", F.lit(True))
    own = known.join(names, ["device", "block", "group"]).withColumn("lost", F.lit(False))
    both = lost.unionByName(own)
    order = W.partitionBy("device", "block", "group").orderBy("start_ns", "utterance")
    before = F.max(F.when(~F.col("lost"), F.col("end_ns"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(~F.col("lost"), F.col("start_ns"))).over(order.rowsBetween(1, W.unboundedFollowing))
    far = lambda gap: F.when(gap.isNull(), float("inf")).otherwise(F.greatest(gap, F.lit(0)).cast("double"))
    gap = F.least(far(F.col("start_ns") - before), far(after - F.col("end_ns")))
    gaps = both.withColumn("gap", gap).where("lost").groupBy("device", "block", "utterance").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "gap"))), lambda x: x["gap"]).alias("gaps"))
    asked = u.where("speaker is null").join(shuffled(gaps), ["device", "block", "utterance"]).select("device", "block", "utterance", "start_ns", "end_ns", "vec", "gaps")
    return asked.groupBy("device", "block").cogroup(split.groupBy("device", "block")).applyInPandas(_joined_or_none, f"device {device_type}, utterance long, `group` long")


def _joined_or_none(key: tuple, orphans: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    return _joined(key, orphans, groups) if len(orphans) and len(groups) else pd.DataFrame({"device": [], "utterance": [], "group": []})


def matched(claims: DataFrame, left: list[str], right: list[str], *order: Column) -> DataFrame:
    """Greedy matching of ``claims`` in a total order: a claim holds unless an earlier one that holds has its left or right.

    In each round the claims that come first on both sides hold and take theirs with them. What is first of all that
    are left always holds, so the rounds end, and claims that don't touch are settled in the same round."""
    rest, out = written(claims), None
    while not rest.isEmpty():
        first = lambda side: F.row_number().over(W.partitionBy(*side).orderBy(*order)) == 1
        held = written(rest.withColumns({"first_left": first(left), "first_right": first(right)}).where("first_left and first_right").drop("first_left", "first_right"))
        out = held if out is None else out.unionByName(held)
        rest = written(rest.join(shuffled(held.select(*left)), left, "left_anti").join(shuffled(held.select(*right)), right, "left_anti"))
    return rest if out is None else out


def thread_conversations(sentences: DataFrame, rules: Threading | None = None) -> DataFrame:
    """``device, id, conversation, minted, turn`` of ``sentences(device, id, speaker, start_ns, end_ns, embedding, prior)``.

    ``speaker``, ``embedding`` and ``prior`` (the conversation so far) may be null. A conversation inherits the prior id of
    most of its sentences, each id going once to the strongest claim (by count, then id, then time); others get a new
    id made of the device and their first sentence. Turns count changes between known speakers."""
    rules = rules or Threading()
    return settled(lambda: _threaded(sentences, rules))


def _threaded(sentences: DataFrame, rules: Threading) -> DataFrame:
    t = sentences.select("device", "id", "speaker", "start_ns", "end_ns", doubles(F.col("embedding")).alias("embedding"), "prior")
    s, u = _utterances(t, rules)
    known = written(_groups(u, _ties(u, rules)))
    split = written(_split_blocks(known, rules))
    grouped = known.join(shuffled(split.select("device", "block", "group")), ["device", "block", "group"]).select("device", "utterance", "group")
    grouped = grouped.unionByName(_orphans(u, known, split, t.schema["device"].dataType.simpleString()))
    whole = F.min("utterance").over(W.partitionBy("device", "block"))
    # A conversation is known by the number of its first utterance, in its device; a block that isn't split is one.
    cluster = u.select("device", "block", "utterance", whole.alias("whole")).join(shuffled(grouped), ["device", "utterance"], "left").withColumn("cluster", F.min("utterance").over(W.partitionBy("device", F.coalesce("group", "whole"))))
    members = written(s.drop("embedding").join(shuffled(cluster.select("device", "utterance", "cluster")), ["device", "utterance"]))
    claims = members.where("prior is not null").groupBy("device", "cluster", "prior").agg(F.count(F.lit(1)).alias("n"))
    named = matched(claims, ["device", "cluster"], ["device", "prior"], F.desc("n"), F.col("prior"), F.col("cluster")).select("device", "cluster", F.col("prior").alias("inherited"))
    first = members.groupBy("device", "cluster").agg(F.min_by("id", F.struct("start_ns", "id")).alias("first"))
    made = first.join(shuffled(named), ["device", "cluster"], "left").select("device", "cluster", F.coalesce("inherited", F.concat_ws(":", F.col("device").cast("string"), F.col("first").cast("string"))).alias("conversation"), F.col("inherited").isNull().alias("minted"))
    order = W.partitionBy("device", "cluster").orderBy("start_ns", "id")
    before = F.last("speaker", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    changed = F.coalesce((F.col("speaker") != before).cast("long"), F.lit(0))
    turns = number_runs(members.withColumn("changed", changed), ["device", "cluster"], "start_ns", "id", flag="changed", name="turn")
    return turns.join(shuffled(made), ["device", "cluster"]).select("device", "id", "conversation", "minted", "turn")


def conversation_rows(sentences: DataFrame, threaded: DataFrame) -> DataFrame:
    """The catalogue of threaded conversations: ``device, conversation, minted, start_ns, end_ns, speakers, sentences``."""
    both = sentences.select("device", "id", "speaker", "start_ns", "end_ns").join(shuffled(threaded), ["device", "id"])
    return both.groupBy("device", "conversation").agg(
        F.first("minted").alias("minted"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.array_sort(F.collect_set("speaker")).alias("speakers"), F.count(F.lit(1)).alias("sentences"),
    )
