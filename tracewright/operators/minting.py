"""Match or mint: whose a new vector is, when each that is known to be nobody's yet may found an identity for those after it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.scratch import settled, written
from tracewright.operators.settling import SETTLED_AT_ONCE, settled_in_order
from tracewright.operators.vectors import centroids, doubles, knn, normalized


@dataclass(frozen=True)
class Minting:
    """Fixed values of the rule, cosine distances: neighbours beyond ``ceiling`` don't vote, and it takes ``least_votes`` of them;
    up to ``match`` a vector is its identity's, up to ``attach`` it is only attached, and beyond a clean one founds its own."""

    neighbours: int = 15
    least_votes: int = 3
    ceiling: float = 0.55
    match: float = 0.5
    attach: float = 0.72
    majority: float = 0.6
    lead: int = 2


def winner(near: list[tuple[float, int]], rules: Minting) -> tuple[float, int] | None:
    """The distance and identity that the nearest ``(distance, identity)`` agree on, None if they don't.

    The identity of most votes wins, of equal ones the nearer (then the smaller), with 60 % of the votes; or with a third of
    those asked for, a neighbour within ``match`` and two votes more than the next."""
    if len(near) < rules.least_votes:
        return None
    votes: dict[int, list[float]] = {}
    for d, identity in near:
        votes.setdefault(identity, []).append(d)
    (n, d, identity), *rest = sorted((-len(v), min(v), i) for i, v in votes.items())
    runner = -rest[0][0] if rest else 0
    strong = -n >= math.ceil(rules.neighbours / 3) and d <= rules.match and -n >= runner + rules.lead
    return (d, identity) if -n >= rules.majority * len(near) or strong else None


def decision(found: tuple[float, int] | None, clean: bool, may_mint: bool, rules: Minting) -> str:
    if found is not None and found[0] <= rules.match:
        return "match" if clean and may_mint else "attach"
    if found is not None and found[0] <= rules.attach:
        return "attach"
    return "mint" if clean and may_mint else "none"


def minted_id(item: int) -> int:
    """The identity that a vector founds: below zero, so that it is none of the catalogue's."""
    return -item - 1


def _decide(rules: Minting, listed: int):
    def decide(own: dict, links: list[dict]) -> tuple[int | None, str, bool]:
        known = [x for x in links if x["kind"] == "near" and (x["of"] if x["before"] is None else x["identity"]) is not None]
        near = sorted((x["distance"], x["other"], x["of"] if x["before"] is None else x["identity"]) for x in known)[: rules.neighbours]
        # If the list of earlier ones is full, one beyond it may yet be nearer than the last voter.
        before = [x["distance"] for x in links if x["kind"] == "near" and x["before"] is not None]
        short = len(before) >= listed and (len(near) < rules.neighbours or near[-1][0] >= max(before))
        found = winner([(d, i) for d, _, i in near], rules)
        if found is None:
            founders = [(x["distance"], x["of"]) for x in links if x["kind"] == "founder" and (x["before"] is None or x["decision"] == "mint")]
            found = min(founders, default=None)
        made = decision(found, own["clean"], own["may_mint"], rules)
        identity = minted_id(own["item"]) if made == "mint" else found[1] if found is not None and made != "none" else None
        return identity, made, short

    return decide


def match_or_mint(new: DataFrame, known: DataFrame, rules: Minting | None = None, first: int = 4_096, at_once: int = SETTLED_AT_ONCE, listed: int | None = None) -> DataFrame:
    """``id, identity, decision`` of ``new(id, place, vec, clean, may_mint)``, as if taken one after the other by ``place`` (then id).

    Each looks at the nearest attributed vectors, those of ``known(id, identity, vec)`` and those before it, and if these
    do not agree at the nearest identity: the centroids of the known ones, which stay as they are, and the vectors that have
    founded one before it. Ids are unique over both tables and not below zero; vectors have one length, and those that
    are zero or null belong to nobody.

    New vectors go in batches that double in size, each of which finds all before it settled. A batch is compared with the
    attributed vectors and with the founders by blocks, of which few rows each come back; within a batch a vector depends on its
    nearest earlier ones and on earlier ones that may found: clean, and beyond the reach of all founders so far. Since a
    batch is no larger than all before it, what is near nobody is mostly new in it. Those choices are then settled in
    order. If a list of earlier vectors proves too short for the votes, it is made twice as long and the batch settled again."""
    rules = rules or Minting()
    unit = lambda df: df.withColumn("vec", normalized(doubles(F.col("vec")))).where(F.coalesce(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) > 0, F.lit(False)))
    rows, attributed = written(unit(new)), written(unit(known).select("id", "identity", "vec"))
    founders = written(centroids(attributed, "identity", "vec").select("identity", F.col("centroid").alias("vec")))
    n, done = rows.count(), None
    sizes, taken = [], 0
    while taken < n:
        sizes.append(taken := taken + max(first, taken))
    ends = rows.agg(F.percentile_approx("place", F.array(*(F.lit(min(1.0, s / n)) for s in sizes)), 100_000)).first()[0] if n else []
    low = None
    for high in sorted({*ends[:-1]}) + [None] if n else []:
        batch = rows if low is None else rows.where(F.col("place") > low)
        batch, low = written(batch if high is None else batch.where(F.col("place") <= high)), high
        made = settled(lambda b=batch, a=attributed, f=founders: _batch(b, a, f, rules, listed or 2 * rules.neighbours, at_once))
        done = made if done is None else done.unionByName(made)
        with_vec = batch.join(made.where("identity is not null"), "id")
        attributed = written(attributed.unionByName(with_vec.select("id", "identity", "vec")))
        founders = written(founders.unionByName(with_vec.where("decision = 'mint'").select("identity", "vec")))
    nobody = new.select("id").join(rows.select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("identity"), F.lit("none").alias("decision"))
    return nobody if done is None else done.unionByName(nobody)


def _batch(batch: DataFrame, attributed: DataFrame, founders: DataFrame, rules: Minting, listed: int, at_once: int) -> DataFrame:
    asked = batch.select(F.col("id").alias("a"), F.col("vec").alias("x"), F.col("place").alias("a_at"))
    plain = asked.drop("a_at")
    none = F.lit(None).cast("long")
    voters = knn(plain, attributed.select(F.col("id").alias("b"), F.col("vec").alias("y")), rules.neighbours, most=rules.ceiling)
    voters = voters.join(attributed.select(F.col("id").alias("b"), F.col("identity").alias("of")), "b").select(F.col("a").alias("item"), none.alias("before"), F.col("b").alias("other"), "of", "distance", F.lit("near").alias("kind"))
    nearest = written(knn(plain, founders.select(F.col("identity").alias("b"), F.col("vec").alias("y")), 1, same=False).select("a", "b", "distance"))
    founded = nearest.select(F.col("a").alias("item"), none.alias("before"), F.col("b").alias("other"), F.col("b").alias("of"), "distance", F.lit("founder").alias("kind"))
    reach = plain.select("a").join(nearest.select("a", F.col("distance").alias("reach")), "a", "left").select("a", F.coalesce("reach", F.lit(3.0)).alias("reach"))
    may = batch.where("clean and may_mint").join(reach.withColumnRenamed("a", "id"), "id").where(F.col("reach") > rules.attach)
    fresh = may.select(F.col("id").alias("b"), F.col("vec").alias("y"), F.col("place").alias("b_at"))
    close = knn(asked, fresh, None, most=rules.attach, earlier=True).join(reach, "a").where(F.col("distance") < F.col("reach"))
    close = close.select(F.col("a").alias("item"), F.col("b").alias("before"), F.col("b").alias("other"), (-F.col("b") - 1).alias("of"), "distance", F.lit("founder").alias("kind"))
    static = written(voters.unionByName(founded).unionByName(close))
    items = batch.select(F.col("id").alias("item"), "place", "clean", "may_mint")
    own = batch.select(F.col("id").alias("b"), F.col("vec").alias("y"), F.col("place").alias("b_at"))
    while True:
        before = knn(asked, own, listed, most=rules.ceiling, earlier=True)
        before = before.select(F.col("a").alias("item"), F.col("b").alias("before"), F.col("b").alias("other"), none.alias("of"), "distance", F.lit("near").alias("kind"))
        made = written(settled_in_order(items, static.unionByName(before), _decide(rules, listed), "identity long, decision string, short boolean", at_once))
        if made.where("short").isEmpty():
            return made.select(F.col("item").alias("id"), "identity", "decision")
        listed *= 2
