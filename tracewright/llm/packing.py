"""Packing documents into training sequences: cutting stock by column generation."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.bpe_ids import word_ids
from tracewright.llm.shared import written

SEQUENCE = 2048
#: The id that ends each document.
END_ID = 1
#: The linear program has a row for each length class; lengths are rounded up to SEQUENCE / CLASSES tokens for it.
CLASSES = 256
#: Column generation stops when the program is within this share of its lower bound.
GAP = 2e-3
#: How far pricing is drawn towards the multipliers of the best bound, and patterns that may enter at a pricing.
PULL, COLUMNS = 0.7, 20
#: Parts of the plan in each of which every pattern has its share, so that sequences follow the order of the documents.
TURNS = 256
#: Texts that are encoded at a time.
TEXTS = 256

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, part string, in_part bigint"
_PIECE = pa.schema([(n, {"class": pa.int32(), "part": pa.string()}.get(n, pa.int64())) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "in_part")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(docs: DataFrame, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, classes: int = CLASSES) -> DataFrame:
    """Pieces of ``docs(doc_id, text[, file, row])``: full sequences first, then what remains of a document.

    ``class`` is the length in units, rounded up; ``in_part`` counts the pieces of a class within a part, which is a run of
    rows of one file or, if these are not told, a task's partition. Names of parts sort in the order of the documents."""
    unit = sequence // classes

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        part, seen, last = f"{TaskContext.get().partitionId():010d}", np.zeros(classes + 1, np.int64), (None, -1)
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                places = zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True) if some.num_columns > 2 else [None] * some.num_rows
                for doc, ids, place in zip(some.column(0).to_pylist(), encoder.of([t or "" for t in some.column(1).to_pylist()]), places, strict=True):
                    if place is not None:
                        if place[0] != last[0] or place[1] < last[1]:
                            part, seen = f"{place[0]}#{place[1]:020d}", np.zeros(classes + 1, np.int64)
                        last = place
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, sequence):
                        length = min(sequence, total - start)
                        kind = -(-length // unit)
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, kind, part, int(seen[kind])))
                        seen[kind] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.mapInArrow(pieces, PIECE)


def _price(duals: np.ndarray, items: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The unbounded knapsack by dynamic programming: item c takes c units and is worth duals[c].

    Returns the best worth, and for each item the best pattern that holds it, the worthiest first."""
    capacity = len(duals) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worths = duals[items]
    for w in range(1, capacity + 1):
        fit = np.searchsorted(items, w, "right")
        if fit:
            worth = worths[:fit] + best[w - items[:fit]]
            k = int(worth.argmax())
            best[w], last[w] = worth[k], items[k]
        if best[w] <= best[w - 1]:
            best[w], last[w] = best[w - 1], 0
    values = worths + best[capacity - items]
    patterns = []
    for k in np.argsort(-values):
        if values[k] <= 1:
            break
        pattern, w = np.zeros(capacity + 1), capacity - int(items[k])
        pattern[items[k]] = 1
        while w > 0:
            pattern[last[w]] += last[w] > 0
            w -= max(1, int(last[w]))
        patterns.append(pattern[items])
    return float(best[capacity]), patterns


def _linear_program(demand: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often to cut each (not whole numbers) so that the demand is met with the fewest sequences.

    Columns are priced with the simplex multipliers drawn towards those of a packing without gaps, where a piece is worth
    its share of a sequence; each pricing also gives the lower bound that ends the search. A small fixed perturbation
    of the demand keeps the many ties from stalling it.
    """
    capacity = len(demand) - 1
    items = np.flatnonzero(demand)
    m = len(items)
    noise = np.random.default_rng(1)
    wanted = demand[items] * (1 + 1e-3 * noise.random(m)) + 1e-2 * noise.random(m)
    columns = np.diag((capacity // items).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ wanted
    centre, pull = items / capacity, PULL
    lower = centre @ wanted
    while amount.sum() > lower * (1 + gap):
        exact = np.maximum(inverse.sum(axis=0), 0)
        duals = np.zeros(capacity + 1)
        duals[items] = pull * centre + (1 - pull) * exact
        value, patterns = _price(duals, items)
        bound = duals[items] @ wanted / max(value, 1)
        if bound > lower:
            lower, centre = bound, duals[items] / max(value, 1)
        entered = 0
        for entering in patterns[:COLUMNS]:
            if entering @ inverse.sum(axis=0) <= 1 + 1e-9:
                continue
            step = inverse @ entering
            ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                continue
            columns[:, out] = entering
            amount = np.maximum(amount - ratio[out] * step, 0)
            amount[out] = ratio[out]
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            entered += 1
        if not entered:
            if pull == 0:
                break
            pull = 0.0
        else:
            pull = PULL
    patterns = np.zeros((m, capacity + 1), np.int64)
    patterns[:, items] = columns.T.round()
    return patterns, amount


def cutting_plan(demand: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that use up ``demand[c]`` pieces of each class c exactly.

    The program's solution is rounded down; what it leaves, a few pieces for each pattern, is packed by first fit, the
    longest first. The plan depends on the histogram only, so its size does not grow with the corpus."""
    demand = demand.astype(np.int64).copy()
    capacity = len(demand) - 1
    plan: list[tuple[np.ndarray, int]] = []
    if demand[capacity]:
        alone = np.zeros(capacity + 1, np.int64)
        alone[capacity] = 1
        plan.append((alone, int(demand[capacity])))
        demand[capacity] = 0
    if demand.any():
        for pattern, amount in zip(*_linear_program(demand, gap), strict=True):
            whole = int(amount + 1e-9)
            while whole and (pattern * whole > demand).any():
                whole -= 1
            if whole:
                plan.append((pattern, whole))
                demand -= pattern * whole
    while demand.any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        for c in np.flatnonzero(demand)[::-1]:
            take = min(int(demand[c]), room // int(c))
            pattern[c], room = take, room - take * int(c)
        times = int((demand[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        demand -= pattern * times
    return plan


def _in_turns(plan: list[tuple[np.ndarray, int]], turns: int) -> list[tuple[np.ndarray, int]]:
    """The plan dealt over ``turns``: each pattern as often as before, evenly, rare ones at different turns."""
    times = np.array([t for _, t in plan], np.int64)
    phase = np.arange(len(plan)) * turns // max(1, len(plan))
    # A count times a turn stays far below the range of 64 bits.
    ends = (np.arange(turns + 1)[:, None] * times + phase) // turns
    return [(plan[k][0], int(n)) for turn in np.diff(ends, axis=0) for k, n in enumerate(turn) if n]


def _slots(plan: list[tuple[np.ndarray, int]], classes: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first rank, pieces a sequence and first sequence of the runs that its ranked pieces fill."""
    runs: dict[int, list] = {}
    filled, sequence = np.zeros(classes + 1, np.int64), 0
    for pattern, times in plan:
        for c in np.flatnonzero(pattern):
            runs.setdefault(int(c), []).append((filled[c], pattern[c], sequence))
            filled[c] += pattern[c] * times
        sequence += times
    return {c: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for c, own in runs.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, classes: int = CLASSES, place: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``sequence`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A document's tokens are the
    tokenizer's ids of its whole text (special tokens are not added) and ``end_id``. It is cut into full sequences and
    a rest. A linear program over the histogram of rests, its columns generated by a knapsack, says how many sequences
    of which pattern to make. The patterns take turns, and the pieces of a class fill their places in the order of the
    documents, so sequences follow that order too. It is that of the input's partitions or, if ``place`` names a column
    with the name of a row's file and one with its number in it, that of file names and numbers. ``sequence_id`` runs from 0 without gaps, and offsets within a sequence from 0 without gaps.

    A null text counts as empty and gives one piece with ``end_id`` alone, as does an empty one. Every row of the input
    is packed, equal ids and null ids too. Other columns are ignored. No rows give no rows.

    The driver sees the histogram alone (``classes`` rows). Ranks come from counts by task and class; no task holds a
    whole class.
    """
    tokenizer = tokenizer or default_tokenizer()
    where = [F.col(place[0]).cast("string"), F.col(place[1]).cast("long")] if place else []
    pieces = written(cut(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *where), tokenizer, end_id, sequence, classes))
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(classes + 1, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        demand[r["class"]] = r["n"]
    slots = _slots(_in_turns(cutting_plan(demand), TURNS), classes)

    before = F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("class", "part", before.alias("before")), ["class", "part"]).withColumn("rank", F.col("before") + F.col("in_part"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            ids = np.zeros(len(ranks), np.int64)
            for c in np.unique(kinds):
                here = kinds == c
                first, each, at = slots[int(c)]
                k = np.searchsorted(first, ranks[here], "right") - 1
                ids[here] = at[k] + (ranks[here] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids), batch.column(6)], names=[*batch.schema.names[:5], "sequence_id", "rank"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select(*columns, "class", "rank").mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, rank bigint")
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
