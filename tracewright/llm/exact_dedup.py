"""Exact duplicate removal by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import tasks_for, written

#: The bytes that normalisation deletes: space and U+0009 to U+000D. They are ASCII, so deleting them from UTF-8 is safe.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of the first digit; each further digit ends at FACTOR times the prefix before it.
FIRST, FACTOR = 16, 4
#: A bucket with more than 1/BUCKETS of all documents, and more than LEAST of them, is split by its next digit. So at most
#: BUCKETS prefixes are ever listed, each no longer than the texts it stands for: together at most BUCKETS times the mean
#: text, whatever the corpus holds.
BUCKETS, LEAST = 65_536, 64

_CELL = pa.schema([("norm", pa.binary()), ("sha", pa.string()), ("members", pa.list_(pa.int64())), ("size", pa.int64()), ("best_len", pa.int64()), ("best_id", pa.int64())])
CELL = "norm binary, sha string, members array<bigint>, size bigint, best_len bigint, best_id bigint"
RESULT = "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"


#: (code points, id) of no row yet.
NONE = (-1, None)


def _better(length: int, doc: int | None, than: tuple) -> tuple:
    if doc is None or length < than[0] or (length == than[0] and doc > than[1]):
        return than
    return length, doc


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one Arrow batch become one row, which bounds a hot group to a row for each batch."""
    for batch in batches:
        found: dict[bytes, list] = {}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            norm = text.encode("utf-8", "surrogatepass").translate(None, SPACES)
            cell = found.setdefault(norm, [[], NONE])
            cell[0].append(doc)
            cell[1] = _better(len(text), doc, cell[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                pa.array([c[0] for c in found.values()], pa.list_(pa.int64())),
                pa.array([len(c[0]) for c in found.values()], pa.int64()),
                pa.array([c[1][0] for c in found.values()], pa.int64()),
                pa.array([c[1][1] for c in found.values()], pa.int64()),
            ],
            schema=_CELL,
        )


def _digit_end(level: int) -> int:
    return FIRST * FACTOR**level


def _big_buckets(cells: DataFrame, most: int) -> list[set[bytes]]:
    """For each level the prefixes that more than ``most`` documents share: at most BUCKETS of them.

    Level by level, only members of a bucket that is still too large are split by their next digit; a text that has
    ended stays in the bucket of its whole bytes."""
    levels: list[set[bytes]] = []
    active = cells.select("norm", "size")
    while True:
        end = _digit_end(len(levels))
        prefix = F.substring("norm", 1, end)
        rows = active.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("n")).where(F.col("n") > most).select("prefix").collect()
        big = {bytes(r.prefix) for r in rows}
        levels.append(big)
        open_ = [p for p in big if len(p) == end]
        if not open_:
            return levels
        listed = cells.sparkSession.createDataFrame([(bytearray(p),) for p in open_], "prefix binary")
        active = written(active.join(F.broadcast(listed), prefix == F.col("prefix"), "left_semi"))


def _levels(cells: DataFrame, most: int) -> tuple[list[set[bytes]], dict[bytes, int]]:
    """The large buckets of each level, and a number for each of those in which texts have ended."""
    levels = _big_buckets(cells, most)
    return levels, {p: i for i, p in enumerate(sorted(p for k, big in enumerate(levels) for p in big if len(p) < _digit_end(k)))}


def _bucket_of(norm: bytes, levels: list[set[bytes]], ended: dict[bytes, int]) -> tuple[bytes | None, int | None]:
    """The shortest prefix that few share, or the number of the large bucket within which the text has ended."""
    for k, big in enumerate(levels):
        prefix = norm[: _digit_end(k)]
        if prefix not in big:
            return prefix, None
        if len(prefix) < _digit_end(k):
            return None, ended[prefix]
    return norm[: _digit_end(len(levels))], None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by norm: each run of equal bytes is a group. Only the open run's cells are held."""
    norm, run = None, []
    out: list[tuple] = []

    def close() -> None:
        best, total = NONE, sum(c[2] for c in run)
        for _, _, _, length, doc in run:
            best = _better(length, doc, best)
        for sha, members, *_ in run:
            out.extend((d, best[1], total, d is not None and d == best[1], sha) for d in members)

    schema = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string())])

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if row[0] != norm and run:
                close()
                run = []
            norm = row[0]
            run.append(row[1:])
        if len(out) >= 10_000:
            yield flush()
    if run:
        close()
    if out:
        yield flush()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after deleting every space and U+0009 to U+000D; of equal texts the one
    with the most code points, then the smallest id stays. Equality compares the bytes themselves: ``text_sha256``
    is only reported.

    Documents are dealt into buckets by a prefix of their bytes. A bucket that more than 1/``buckets`` of all
    documents share is split by its next digit, and so on until it is small or its texts have ended; texts ended in
    a large bucket are equal without further reading and need no shuffle, only a sum. Small buckets are sorted, the
    last digits by the sort's byte comparisons, and runs of equal bytes are the groups.

    Null texts count as empty; empty texts are equal to each other. Rows with the same id and text count as separate
    copies, and each of them is kept if its id is. A null id never stays if another copy has one. Other columns of
    ``docs`` are ignored. No rows give no rows.
    """
    cells = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cells, CELL))
    docs_n, nbytes = cells.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()
    levels, ended = _levels(cells, max(least, docs_n // buckets))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [_bucket_of(x, levels, ended) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w[0] for w in where], pa.binary()), pa.array([w[1] for w in where], pa.int64())], schema=_CELL.append(pa.field("bucket", pa.binary())).append(pa.field("ended", pa.int64())))

    where = cells.mapInArrow(dealt, f"{CELL}, bucket binary, ended bigint")
    few = where.where("ended is null").repartition(tasks_for(cells, nbytes), "bucket").sortWithinPartitions("norm")
    result = few.drop("bucket", "ended").mapInArrow(_runs, RESULT)
    if not ended:
        return result
    # Of texts that have ended in a large bucket there are at most ``buckets``, so their sums fit a broadcast.
    hot = where.where("ended is not null").select("ended", "sha", "members", "size", "best_len", "best_id")
    best = F.max(F.when(F.col("best_id").isNotNull(), F.struct("best_len", (-F.col("best_id")).alias("minus_id"))))
    sums = hot.groupBy("ended").agg(F.sum("size").alias("group_size"), best.alias("best")).select("ended", "group_size", (-F.col("best.minus_id")).alias("keep_id"))
    hot = hot.select("ended", "sha", F.explode("members").alias("doc_id")).join(F.broadcast(sums), "ended")
    return result.unionByName(hot.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256")))


def _firsts(norm_at: int):
    """Of rows sorted by norm the first of each run, without the norm, which stands last."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            norms = batch.column(norm_at).to_pylist()
            keep = [x != y for x, y in zip(norms, [last, *norms], strict=False)]
            last = norms[-1] if norms else last
            yield batch.select(range(norm_at)).filter(pa.array(keep, pa.bool_()))

    return rows


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with their columns as they are.

    Groups and the choice are those of ``exact_dedup``, but the rows themselves are dealt into the buckets, so each text
    is shuffled once and nothing is joined back: ids may be null or repeat. Of rows alike in length, those with an id
    come first, then those of the smallest id; of rows alike in all of this any one stays."""
    columns, ours = docs.columns, "tracewright_row"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias(ours), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    kind = rows.schema[ours].dataType
    cells_kind = T.StructType([T.StructField(ours, kind), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("size", T.LongType())])

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, list] = {}
            for i, (t, doc) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                norm, rank = t.encode("utf-8", "surrogatepass").translate(None, SPACES), (-len(t), doc is None, doc or 0)
                own = best.setdefault(norm, [rank, i, 0])
                own[2] += 1
                if rank < own[0]:
                    own[:2] = rank, i
            chosen = batch.take(pa.array([b[1] for b in best.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array([b[2] for b in best.values()], pa.int64())], names=[*batch.schema.names, "size"])

    # The text is not written twice: it is read from the row again.
    cells = written(rows.mapInArrow(collapsed, cells_kind).drop("text"))
    cells = cells.withColumn("text", F.coalesce(F.col(f"{ours}.`{text_col}`").cast("string"), F.lit("")))
    norm = F.encode(F.translate("text", SPACES.decode(), ""), "UTF-8")
    docs_n, nbytes = cells.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    levels, ended = _levels(cells.select(norm.alias("norm"), "size"), max(least, docs_n // buckets))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [_bucket_of(x.encode("utf-8", "surrogatepass").translate(None, SPACES), levels, ended) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([w[0] for w in where], pa.binary()), pa.array([w[1] for w in where], pa.int64())], names=[ours, "doc_id", "bucket", "ended"])

    dealt_kind = T.StructType([*cells_kind.fields[:1], cells_kind.fields[2], T.StructField("bucket", T.BinaryType()), T.StructField("ended", T.LongType())])
    where = cells.select(ours, "doc_id", "text").mapInArrow(dealt, dealt_kind)
    order = [F.desc(F.length("text")), F.col("doc_id").asc_nulls_last()]
    few = where.where("ended is null").repartition(tasks_for(cells, nbytes), "bucket").withColumn("text", F.coalesce(F.col(f"{ours}.`{text_col}`").cast("string"), F.lit("")))
    few = few.withColumn("norm", norm).sortWithinPartitions("norm", *order).select(ours, "norm").mapInArrow(_firsts(1), T.StructType(cells_kind.fields[:1]))
    if ended:
        hot = where.where("ended is not null").withColumn("n", F.length(F.coalesce(F.col(f"{ours}.`{text_col}`").cast("string"), F.lit(""))))
        # The least rank first: longer texts, then rows with an id, then smaller ids.
        few = few.unionByName(hot.groupBy("ended").agg(F.min_by(ours, F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias(ours)).select(ours))
    return few.select(*(F.col(f"{ours}.`{c}`").alias(c) for c in columns))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n_points, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
