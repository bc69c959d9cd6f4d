"""Vector functions on arrays of doubles, nearest neighbours and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.scratch import written


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for vectors of different lengths and for a zero vector."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), 1.0).otherwise(1 - dot(a, b) / length)


def normalized(a: Column) -> Column:
    """The norm is bound by a lambda: as an expression it would be computed again for each component."""
    made = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))
    return F.element_at(made, 1)


def top_k(df: DataFrame, query: list[float], vec: str, key: str, k: int, most: float | None = None) -> DataFrame:
    """The k nearest rows by cosine distance, ties by key; at most ``most`` away if given."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = df.withColumn("distance", cosine_distance(doubles(F.col(vec)), q))
    return (found if most is None else found.where(F.col("distance") <= most)).orderBy("distance", key).limit(k)


def kept_within_margin(df: DataFrame, margin: float) -> DataFrame:
    """Rows at most ``margin`` further away than the nearest; a margin of 0 or less keeps all."""
    if margin <= 0:
        return df
    nearest = df.agg(F.min("distance").alias("nearest"))  # one row
    return df.join(F.broadcast(nearest), F.col("distance") <= F.col("nearest") + margin).drop("nearest")


#: Vectors in a block of the products of all queries and rows.
BLOCK = 4_096
#: Vectors in a block at most where each is copied for every block, and about as many blocks as give all tasks work.
LARGE, SPREAD = 131_072, 8
#: Queries and rows that a task multiplies at once, and the share of their pairs up to which each pair's product is made by itself.
QUERIES, ROWS, FEW = 1_024, 2_048, 1 / 32


def block_size(n: int) -> int:
    """Blocks of n vectors: as few as there is work for, since what is shuffled grows with the square of their number."""
    return max(BLOCK, min(LARGE, -(-n // SPREAD)))


def _matrix(t: pa.Table, c: str) -> np.ndarray:
    return np.asarray(t.column(c).combine_chunks().flatten(), float).reshape(len(t), -1)


def _nearest(k: int | None, most: float | None, same: bool, earlier: bool):
    def some(a: np.ndarray, x: np.ndarray, at: np.ndarray | None, b: np.ndarray, y: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Of some queries the k nearest rows, ROWS at a time: what is no nearer than the k found so far is passed over.

        Products in single precision tell which pairs may count, up to the most that they may be off; only those are made in double."""
        rough, longest = x.astype(np.float32), lambda v: float(np.sqrt(np.max(np.square(v).sum(1), initial=0, where=np.isfinite(v).all(1))))
        size = longest(x)
        bound = np.full(len(a), np.inf if most is None else most)
        row, other, near = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
        found = []
        for low in range(0, len(b), ROWS):
            ids = b[low : low + ROWS]
            some_y = y[low : low + ROWS]
            like = rough @ some_y.astype(np.float32).T
            off = (x.shape[1] + 4) * 6e-8 * size * longest(some_y)
            later = lambda i, j: (before[low : low + ROWS][j] > at[i]) | ((before[low : low + ROWS][j] == at[i]) & (ids[j] >= a[i]))  # noqa: B023, E731
            if k is not None and not low and len(ids) >= k + same:
                like[np.isnan(like)] = -np.inf
                if earlier:
                    like[later(np.arange(len(a))[:, None], np.arange(len(ids))[None, :])] = -np.inf
                # The query itself may be one of these rows.
                limit = 1 - np.partition(like, len(ids) - k - same, axis=1)[:, len(ids) - k - same].astype(float) + off
                limit = np.minimum(bound, limit)
            else:
                limit = bound
            least = (1 - limit - off).astype(np.float32)
            i, j = np.nonzero(like >= np.nextafter(least, np.float32(-np.inf))[:, None])
            if len(i) > FEW * like.size:
                d = (1 - x @ some_y.T)[i, j]
            else:
                d = 1 - np.einsum("ij,ij->i", x[i], some_y[j])
            near_enough = (d <= limit[i]) & ~later(i, j) if earlier else d <= limit[i]
            i, j, d = i[near_enough], j[near_enough], d[near_enough]
            kept = np.isfinite(d) & (a[i] != ids[j]) if same else np.isfinite(d)
            i, j, d = i[kept], j[kept], d[kept]
            if k is None:
                found.append((i, ids[j], d))
            elif len(i):
                row, other, near = np.concatenate([row, i]), np.concatenate([other, ids[j]]), np.concatenate([near, d])
                order = np.lexsort((other, near, row))
                row, other, near = row[order], other[order], near[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                bound[row[place == k - 1]] = near[place == k - 1]
                row, other, near = row[place < k], other[place < k], near[place < k]
        if k is None and found:
            row, other, near = (np.concatenate(c) for c in zip(*found, strict=True))
        return a[row], other, near

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        """The pairs of two blocks: of each ``a`` the k nearest (all that are near enough, if k is None), QUERIES at a time."""
        a, b = np.asarray(left.column("a")), np.asarray(right.column("b"))
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        x, y = _matrix(left, "x"), _matrix(right, "y")
        at, before = (np.asarray(left.column("a_at")), np.asarray(right.column("b_at"))) if earlier else (None, None)
        made = [some(a[i : i + QUERIES], x[i : i + QUERIES], at[i : i + QUERIES] if earlier else None, b, y, before) for i in range(0, len(a), QUERIES)]
        one, two, far = (np.concatenate(c) for c in zip(*made, strict=True))
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64()), "distance": pa.array(far)})

    return found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where(F.col("k") <= k).select("a", "b", "distance", "k")


def knn(queries: DataFrame, rows: DataFrame, k: int | None, block: int | None = None, most: float | None = None, same: bool = True, earlier: bool = False) -> DataFrame:
    """The k nearest ``rows(b, y)`` for each of ``queries(a, x)`` by unit vectors' cosine distance: ``a, b, distance, k``.

    Exact: queries and rows are dealt into blocks, about SPREAD of each unless these are too large (``block_size``) or ``block``
    says otherwise, and each task multiplies one block of queries with one of rows as matrices, a piece at a time, and keeps k
    for each query. So a task's memory is that of two blocks, each vector is copied once for each block of the others, and
    only k rows of each query and block of rows are shuffled to be merged; ties go by ``b``.

    At most ``most`` away; with ``same`` a and b are ids of one table, and a row is no neighbour of itself; with ``earlier`` only
    rows before the query's by ``b_at`` and ``a_at`` (then by id) count. If k is None all that fit are returned, without ``k``."""
    n, n_asked = rows.count(), queries.count()
    parts, asked_parts = (max(1, -(-m // (block or block_size(m)))) for m in (n, n_asked))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts).cast("long")))
    dealt = dealt.withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked_parts - 1).cast("long"))))
    asked = queries.withColumn("asked", F.pmod(F.xxhash64("a"), F.lit(asked_parts).cast("long")))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = asked.groupBy("asked", "part").cogroup(dealt.groupBy("asked", "part")).applyInArrow(_nearest(k, most, same, earlier), "a long, b long, distance double")
    return found if k is None else _ranked(found, k)


#: What angles are rounded by; a block is left out only if it is further than this beyond the bound.
ANGLE_SLACK = 1e-6


def pivot_blocks(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``rows(b, y)`` with their ``pivot`` and ``part``, and the blocks ``pivot, part, n, radius`` with the pivot's vector ``centre``.

    Pivots are as many rows as there are blocks, those of the least hash; a row belongs to the nearest, and what is near one
    pivot is parted by hash if it is more than a block."""
    n = rows.count()
    pivots = written(rows.orderBy(F.xxhash64("b"), "b").limit(max(1, -(-n // block))).select(F.col("b").alias("pivot"), F.col("y").alias("centre")))
    own = knn(rows.select(F.col("b").alias("a"), F.col("y").alias("x")), pivots.select(F.col("pivot").alias("b"), F.col("centre").alias("y")), 1, block, same=False)
    own = own.select(F.col("a").alias("b"), F.col("b").alias("pivot"), F.acos(F.greatest(F.least(1 - F.col("distance"), F.lit(1.0)), F.lit(-1.0))).alias("angle"))
    sizes = own.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
    dealt = written(rows.join(own, "b").join(sizes, "pivot").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts"))
    blocks = dealt.groupBy("pivot", "part").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).join(pivots, "pivot")
    return dealt.drop("angle"), written(blocks)


def pivot_pairs(queries: DataFrame, blocks: DataFrame, bound: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, pivot, part`` of the blocks that may hold a row within the angle ``bound(a, angle)`` of a query: the centre lies at most
    the block's radius further off."""
    centres = blocks.groupBy("pivot").agg(F.first("centre").alias("y"), F.max("radius").alias("radius"))
    # The centres' radii are joined by key after the products, whose rows are one for each query and centre that may count.
    near = knn(queries, centres.select(F.col("pivot").alias("b"), "y"), None, block, same=False)
    angle = F.acos(F.greatest(F.least(1 - F.col("distance"), F.lit(1.0)), F.lit(-1.0)))
    near = near.select("a", F.col("b").alias("pivot"), angle.alias("to_centre")).join(bound, "a").join(blocks.select("pivot", "part", "radius"), "pivot")
    return near.where(F.col("to_centre") <= F.col("angle") + F.col("radius") + ANGLE_SLACK).select("a", "pivot", "part")


def knn_by_pivots(queries: DataFrame, rows: DataFrame, k: int, block: int | None = None, multiplied: list[int] | None = None) -> DataFrame:
    """As ``knn``, but a query meets only the blocks that can hold one of its k nearest.

    Rows are dealt around pivots. A query's nearest block gives it a kth distance, and by the triangle inequality of
    angles no block whose centre is further than that and its radius can better it. What is left is multiplied block by
    block. A query is copied for each block that it meets, so blocks are large (``block_size``) unless ``block`` says otherwise.
    ``multiplied`` takes the number of pairs that were multiplied in the two steps."""
    n = rows.count()
    block = block_size(n) if block is None else block
    if n <= block:
        return knn(queries, rows, k, block)
    dealt, blocks = pivot_blocks(rows, block)
    centres = blocks.groupBy("pivot").agg(F.first("centre").alias("y")).select(F.col("pivot").alias("b"), "y")
    first = knn(queries, centres, 1, block, same=False).select("a", F.col("b").alias("pivot")).join(blocks.select("pivot", "part"), "pivot")
    first = written(first.select("a", "pivot", "part"))

    def met(pairs: DataFrame) -> DataFrame:
        """The k nearest of each query in the blocks that it is paired with; queries of one block go in groups."""
        group = F.pmod(F.xxhash64("a"), F.col("groups"))
        many = pairs.groupBy("pivot", "part").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("groups"))
        asked = pairs.join(many, ["pivot", "part"]).withColumn("group", group).join(queries, "a").select("a", "x", F.col("pivot").alias("p"), F.col("part").alias("q"), F.col("group").alias("g"))
        held = dealt.join(many, ["pivot", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("b", "y", F.col("pivot").alias("p"), F.col("part").alias("q"), F.col("group").alias("g"))
        return asked.groupBy("p", "q", "g").cogroup(held.groupBy("p", "q", "g")).applyInArrow(_nearest(k, None, True, False), "a long, b long, distance double")

    near = written(met(first))
    kth = _ranked(near, k).where(F.col("k") == k).select("a", F.acos(F.greatest(1 - F.col("distance"), F.lit(-1.0))).alias("angle"))
    bound = queries.select("a").join(kth, "a", "left").select("a", F.coalesce("angle", F.lit(np.pi)).alias("angle"))
    rest = written(pivot_pairs(queries, blocks, bound, block).join(first, ["a", "pivot", "part"], "left_anti"))
    if multiplied is not None:
        multiplied += [pairs.join(blocks, ["pivot", "part"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for pairs in (first, rest)]
    return _ranked(near.unionByName(met(rest)), k)


def _summed(table: pa.Table, keys: list[str]) -> pa.Table:
    """One row for each key of the table, in the order of their first rows: ``keys, n, total``."""
    at = table.select(keys).to_pandas(integer_object_nulls=True).groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    codes, first = np.unique(at, return_index=True)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], codes)
    x = np.asarray(table.column("total").combine_chunks().flatten(), float).reshape(len(table), -1)
    n = np.asarray(table.column("n"), float)
    return table.select(keys).take(pa.array(first)).append_column("n", pa.array(np.add.reduceat(n[order], starts))).append_column("total", pa.array(list(np.add.reduceat(x[order], starts, axis=0)), pa.list_(pa.float64())))


def vector_sums(df: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """``keys, n, total``: the weights of each key's vectors and their weighted sum; null vectors don't count.

    Vectors are added as arrays: in each Arrow batch before the shuffle, then by sorted runs of the key, so that a task holds
    a batch and one sum, however many vectors a key has. Vectors of different lengths are added apart, and of a key's
    sums that of the most weight (then the longer one) is returned."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.where(F.col(vec).isNotNull()).select(*keys, F.size(vec).alias("length"), w.alias("n"), F.transform(doubles(F.col(vec)), lambda x: x * w).alias("total"))
    by = [*keys, "length"]

    def whole(batch: pa.RecordBatch) -> pa.Table:
        """Batches hold vectors of several lengths; those of one length are summed as a matrix."""
        t = pa.Table.from_batches([batch])
        lengths = np.asarray(t.column("length"))
        return pa.concat_tables([_summed(t.filter(pa.array(lengths == k)), by) for k in np.unique(lengths)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from whole(batch).cast(batch.schema).to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = whole((t if held is None else pa.concat_tables([held, t])).combine_chunks().to_batches()[0]).cast(batch.schema)
            held = t.slice(len(t) - 1)
            yield from t.slice(0, len(t) - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    parts = rows.mapInArrow(partial, rows.schema).repartition(*by).sortWithinPartitions(*by).mapInArrow(final, rows.schema)
    best = F.max_by(F.struct("n", "total"), F.struct("n", "length"))
    return parts.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.n", "best.total")


def centroids(df: DataFrame, key: str, vec: str, weight: Column | None = None) -> DataFrame:
    """The mean of each key's vectors, of unit length: ``key, n, centroid``."""
    sums = vector_sums(df, [key], vec, weight)
    counts = df.where(F.col(vec).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    mean = F.transform("total", lambda x: x / F.greatest(F.col("n"), F.lit(1.0)))
    return sums.join(counts, key).select(key, F.col("rows").alias("n"), normalized(mean).alias("centroid"))


def vote(neighbours: DataFrame, near: float, majority: float = 0.6) -> DataFrame:
    """For ``neighbours(a, identity, distance)``: the identity that wins, or null.

    The most votes win, then the least distance. A win needs 60 % of the votes, or a third of them rounded up, a neighbour
    within ``near`` and two votes more than the next."""
    counts = neighbours.where("identity is not null").groupBy("a", "identity").agg(F.count(F.lit(1)).alias("votes"), F.min("distance").alias("best"))
    order = W.partitionBy("a").orderBy(F.desc("votes"), "best", "identity")
    counts = counts.withColumns({"k": F.row_number().over(order), "next": F.coalesce(F.lead("votes").over(order), F.lit(0)), "all": F.sum("votes").over(W.partitionBy("a"))})
    wins = (F.col("votes") >= majority * F.col("all")) | ((F.col("votes") >= F.ceil(F.col("all") / 3)) & (F.col("best") <= near) & (F.col("votes") - F.col("next") >= 2))
    return counts.where("k = 1").select("a", F.when(wins, F.col("identity")).alias("winner"), "votes", F.col("all").alias("asked"))
