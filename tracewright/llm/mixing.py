"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.shared import written

#: Documents in a block, the unit that is scheduled.
BLOCK_ROWS = 16
#: Least slots of a round. A round is long enough for a block of the least weight; weights below LEAST count as LEAST.
SLOTS, LEAST = 512, 2.0**-16
#: Weights are whole multiples of one over about this.
GRAIN = 2**40
#: Target weights are the sources' shares to this power: 1 keeps the corpus as it is, 0 makes all sources equal.
TEMPERATURE = 0.5
#: Rows of a source that are ranked together, and groups of them whose sizes are summed together.
RANKED, SUMMED = 512, 1_024
#: Rounds of a source that are listed at a time.
LISTED = 4_096

#: One round. ``s`` holds for each source its c blocks of the round, the time A (from the round's start, in slots) and the
#: remainder r at which the first is released, so that block j is released at A + floor((r + j*Q)/q) and due at
#: A + ceil((r + (j+1)*Q)/q), within the round. Each step takes the released block with the earliest deadline; if none is
#: released time moves on to the next release, but never so far that the round's blocks no longer fit.
#: Steps are taken by the hundred, so that the order of a long round is not copied at every step.
_ROUND = """
flatten(aggregate(
  sequence(0, (total - 1) div 100),
  named_struct('t', 0L, 'done', transform(s, x -> 0L), 'order', cast(array() as array<array<struct<k: int, j: bigint, slot: bigint, released: bigint, due: bigint>>>)),
  (whole, hundred) -> transform(array(
    aggregate(
      sequence(hundred * 100 + 1, least(total, hundred * 100 + 100)),
      named_struct('t', whole.t, 'done', whole.done, 'order', cast(array() as array<struct<k: int, j: bigint, slot: bigint, released: bigint, due: bigint>>)),
      (acc, step) -> transform(
        array(filter(transform(s, (x, i) -> if(acc.done[i] < x.c, named_struct(
          'due', least(length, x.a + (x.r + (acc.done[i] + 1) * grain) div x.q + if((x.r + (acc.done[i] + 1) * grain) % x.q = 0, 0, 1)),
          'released', greatest(0L, x.a + (x.r + acc.done[i] * grain) div x.q),
          'k', cast(i as int)), null)), x -> x is not null)),
        open -> transform(
          array(greatest(acc.t, least(array_min(transform(open, x -> x.released)), length - (total - step + 1)))),
          t -> transform(
            array(array_min(transform(open, x -> named_struct('late', x.released > t, 'due', if(x.released > t, x.released, x.due), 'k', x.k, 'of', x)))),
            b -> named_struct(
              't', t + 1,
              'done', transform(acc.done, (d, i) -> if(i = b.k, d + 1, d)),
              'order', array_append(acc.order, named_struct('k', b.k, 'j', acc.done[b.k], 'slot', t, 'released', b.of.released, 'due', b.of.due))))[0])[0])[0])),
    x -> named_struct('t', x.t, 'done', x.done, 'order', array_append(whole.order, x.order)))[0]).order)
"""


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The slots of all blocks of ``sources(source, weight, blocks)``: ``source, block, slot, released, due``.

    Block i (from 0) of a source with the share w of the weights is released at floor(i/w) and due at ceil((i+1)/w), and
    the released block with the earliest deadline goes first. So that slots can be settled in parallel, time is cut into
    rounds, long enough for each source to have a block in each. At a round's ends the blocks done of each
    source are its share of the time rounded up or down, all sources together exactly the time (running sums of the shares are
    rounded and subtracted); in between the round's blocks are scheduled by their true releases and deadlines. Where several
    sources enter a round nearly a block behind, or have to be ahead at its end, that may be impossible: then a block is
    placed outside its window. Such a round is joined with the two beside it and settled anew without the ends between, until
    every block is within its window; were all rounds joined, that would be plain earliest-deadline-first from the start,
    for which the windows are known to suffice. So every source is less than a block away from its weight at all
    times, however long the run: nothing is repeated from a rounded period. (Weights are rounded to about 2^-40 of all.)

    A null, negative or tiny weight counts as LEAST of all. A round is one row that holds its sources, so the number of
    sources has to fit a task; there may be any number of blocks and rounds.
    """
    w = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    w = F.when(F.isnan(w) | (w == float("inf")), 0.0).otherwise(w)
    total = F.sum(w).over(W.partitionBy(F.lit(0)))
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    share = F.greatest(F.when(total > 0, w / total).otherwise(1.0 / n), F.least(F.lit(LEAST), 0.25 / n))
    grains = sources.select("source", "blocks", F.greatest(F.lit(1), F.round(share * GRAIN)).cast("long").alias("q"))
    everything = W.partitionBy(F.lit(0))
    grains = grains.withColumns({"grain": F.sum("q").over(everything), "before": F.sum("q").over(everything.orderBy("source")) - F.col("q"), "least": F.min("q").over(everything)})
    grains = written(grains.withColumn("length", F.greatest(F.lit(slots).cast("long"), F.expr("(grain + least - 1) div least"))))

    # The rounds of each source, listed in steps, and the blocks done at their ends.
    wide = lambda x: f"cast({x} as decimal(20, 0))"
    last = f"cast({wide('blocks')} * {wide('grain')} div ({wide('q')} * {wide('length')}) as bigint) + 1"
    steps = grains.where("blocks > 0").select("*", F.expr(last).alias("last")).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {LISTED}"))))
    rounds = steps.repartition("source", "step").withColumn("round", F.explode(F.sequence(F.expr(f"step * {LISTED}"), F.least(F.col("last"), F.expr(f"(step + 1) * {LISTED} - 1")))))
    summed = lambda time, q: f"cast(((2 * {wide(time)} * {wide(q)}) + {wide('grain')}) div (2 * {wide('grain')}) as bigint)"
    done = lambda time: F.expr(f"least(blocks, {summed(time, '(before + q)')} - {summed(time, 'before')})")
    rounds = rounds.withColumns({"first": done("round * length"), "next": done("(round + 1) * length")}).where("next > first")
    rounds = written(rounds.select("source", "round", "first", "next", "q", "grain", "length"))
    end = rounds.agg(F.max("round")).first()[0]
    groups = written(rounds.select(F.col("round").alias("start")).distinct().withColumn("stop", F.col("start")))
    done, todo = None, rounds.withColumns({"start": F.col("round"), "stop": F.col("round")})
    while True:
        placed = written(_placed(todo, end))
        done = placed if done is None else done.unionByName(placed)
        missed = placed.where("slot >= due or slot < released").select("start", "stop").distinct()
        wider = written(_joined(missed, groups))
        if wider.isEmpty():
            return done.drop("start", "stop")
        # The rounds of each joined group, and all groups that it takes the place of.
        inside = written(wider.withColumn("round", F.explode(F.sequence("start", "stop"))))
        groups = written(groups.join(inside.select(F.col("round").alias("start")), "start", "left_anti").unionByName(wider))
        done = written(done.join(inside.select(F.col("round").alias("start")), "start", "left_anti"))
        todo = rounds.join(inside, "round")


def _placed(rounds: DataFrame, end: int | None) -> DataFrame:
    """``start, stop, source, block, slot, released, due`` of the blocks of groups of rounds, each group settled in one row. After
    the last round nothing has to be done by its end."""
    wide = lambda x: f"cast({x} as decimal(20, 0))"
    by = ["start", "stop", "length", "grain"]
    own = rounds.groupBy(*by, "source", "q").agg(F.min("first").alias("first"), F.max("next").alias("next"))
    at = f"{wide('first')} * {wide('grain')}"
    row = F.struct("source", "first", (F.col("next") - F.col("first")).alias("c"), F.expr(f"cast({at} div {wide('q')} as bigint) - start * length").alias("a"), F.expr(f"cast({at} % {wide('q')} as bigint)").alias("r"), "q")
    plan = own.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("s"), F.sum(F.col("next") - F.col("first")).alias("total")).withColumn("shift", F.col("start") * F.col("length"))
    # From here on a group has the length of its rounds.
    plan = plan.withColumn("length", F.col("length") * (F.col("stop") - F.col("start") + F.when(F.col("stop") == F.lit(end), 2).otherwise(1)))
    plan = plan.select("start", "stop", "shift", "s", F.explode(F.expr(_ROUND)).alias("o"))
    return plan.select("start", "stop", F.expr("s[o.k].source").alias("source"), F.expr("s[o.k].first + o.j").alias("block"), *((F.col(f"o.{c}") + F.col("shift")).alias(c) for c in ("slot", "released", "due")))


def _joined(missed: DataFrame, groups: DataFrame) -> DataFrame:
    """``start, stop`` of the groups that ``missed`` and their neighbours make; overlapping ones are one."""
    before = groups.select(F.col("start").alias("low"), (F.col("stop") + 1).alias("start"))
    after = groups.select(F.col("stop").alias("high"), (F.col("start") - 1).alias("stop"))
    wide = missed.join(before, "start", "left").join(after, "stop", "left").select(F.coalesce("low", "start").alias("start"), F.coalesce("high", "stop").alias("stop"))
    order = W.partitionBy(F.lit(0)).orderBy("start", "stop")  # two numbers for each round that missed
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    parted = wide.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return parted.groupBy("island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, slots: int = SLOTS, temperature: float = TEMPERATURE) -> DataFrame:
    """Interleave the sources of ``docs`` block by block so that every prefix follows the target weights.

    Adds ``mix_source, mix_block, mix_slot, mix_released, mix_due, mix_position``: blocks are runs of ``block_rows``
    documents of one source in an order mixed by a hash of their ids, ``mix_slot`` is the slot of the block, and ordering by
    ``(mix_slot, mix_position)`` gives the mixture. As long as a source lasts, it is less than one block away from its
    weight at every slot; when it has run out its slots stay empty and the others keep their proportions, so every
    document is placed and none is repeated. ``weights(source, weight)`` gives the targets; without it they are the
    sources' row counts to the power ``temperature``. A source that ``weights`` leaves out has the least weight there is.

    A null source is a source of its own, named by the empty string along with it. Rows with null or equal ids are
    placed too, in the order of all their columns. Columns of ``docs`` stay as they are, whatever their names; only those
    six are replaced. No rows give no rows.

    Ranks within a source come from counts of hashed sub-groups of about RANKED rows, summed in two steps, so no task
    holds a whole source.
    """
    ours = ["mix_source", "mix_block", "mix_slot", "mix_released", "mix_due", "mix_position"]
    docs = docs.drop(*ours)
    kinds = {c: k for c, k in docs.dtypes if "map<" not in k and "variant" not in k}
    hashes = [F.xxhash64(F.col(f"`{c}`")) for c in kinds if c != id_col]
    key = F.col(f"`{id_col}`")
    spread = F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*hashes) if hashes else F.lit(0).cast("long"))
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), source.alias("source"), key.alias("id"), F.array(*hashes).cast("array<bigint>").alias("ties"), spread.alias("spread"))
    counts = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    most = counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    targets = counts.select("source", F.expr(f"(n + {block_rows} - 1) div {block_rows}").alias("blocks"), F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("weight"))
    if weights is not None:
        named = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum("weight").alias("weight"))
        targets = targets.drop("weight").join(named, "source", "left")
    placed = schedule(targets, slots)

    keyed = rows.withColumn("part", F.pmod("spread", F.lit(max(1, -(-most // RANKED))).cast("long")))
    sums = keyed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.expr(f"part div {SUMMED}"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("source", "group").agg(F.sum("n").alias("n")).select("source", "group", earlier(W.partitionBy("source").orderBy("group")).alias("start"))
    before = sums.join(groups, ["source", "group"]).select("source", "part", (F.col("start") + earlier(W.partitionBy("source", "group").orderBy("part"))).alias("before"))
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("source", "part").orderBy("id", "ties")) - 1).join(before, ["source", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc", "source", F.expr(f"rank div {block_rows}").alias("block"), F.expr(f"rank % {block_rows}").cast("long").alias("position"))
    out = ranked.join(placed, ["source", "block"])
    return out.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns), *(F.col(c.removeprefix("mix_")).alias(c) for c in ours))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its own columns, range-partitioned and sorted in the order of the mixture: the rows of the files that
    a writer makes of it follow the mixture in the order of file names and of rows."""
    placed = mix(docs, **options)
    return placed.repartitionByRange(F.col("mix_slot"), F.col("mix_position")).sortWithinPartitions("mix_slot", "mix_position").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_released", "mix_due", "mix_position")
