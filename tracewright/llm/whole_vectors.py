"""Vectors of whole numbers: exact inner products in blocks and the best few rows of each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import written

#: A component x counts as floor(SCALE * x).
SCALE = 256.0
#: Bytes of a block's vectors as doubles, least rows of a block while there are fewer than tasks, and queries at a time.
BLOCK_BYTES, LEAST_ROWS, ASKED = 32 << 20, 1_024, 512
#: Up to here a double holds every whole number.
_EXACT = 2.0**53
FOUND = "row long, w int, id long, candidate long, score long"


def usable(vec: Column) -> Column:
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def numbered(embeddings: DataFrame, id_col: str, vec_col: str, **more: Column) -> DataFrame:
    """The usable rows, written: ``row, id, x, norm`` and ``more``. Row numbers tell apart rows of one id."""
    vec = F.col(f"`{vec_col}`")
    if not (isinstance(kind := embeddings.schema[vec_col].dataType, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        vec = vec.cast("array<double>")
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("x"), *(c.alias(n) for n, c in more.items())).where(usable(F.col("x")))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    return written(rows.withColumns({"row": F.monotonically_increasing_id(), "norm": F.sqrt(square)}))


def block_rows(rows: DataFrame, n: int) -> int:
    """Rows of a block: as many as fit BLOCK_BYTES, fewer while that leaves tasks without one."""
    length = rows.agg(F.max(F.size("x"))).first()[0] or 1
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(BLOCK_BYTES // (8 * max(1, length)), max(LEAST_ROWS, -(-n // tasks))))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """floor(SCALE * x) of lists of numbers, the shorter ones with zeros after their end."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    lengths = np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(lists), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(lists.flatten(), np.float64)
    with np.errstate(over="ignore"):
        out *= SCALE
    return np.floor(np.clip(out, np.finfo(float).min, np.finfo(float).max))


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns, and as Python's whole numbers where doubles could not hold the products."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, width) < _EXACT:
        return a, b
    return tuple(np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows; one beyond a long counts as its end."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    return np.clip(a @ b.T, -(2**63), 2**63 - 1) if a.dtype == object else a @ b.T


class Candidates:
    """A block of rows; ``tie`` is each row's place by id (a null id last), then by row number."""

    def __init__(self, rows: pa.Table) -> None:
        self.row = np.asarray(rows.column("row"))
        self.id = rows.column("id").combine_chunks()
        ids = np.asarray(self.id.fill_null(0))
        order = np.lexsort((self.row, ids, np.asarray(self.id.is_null())))
        self.by_tie = order
        self.tie = np.empty(len(order), np.int64)
        self.tie[order] = np.arange(len(order))
        self.x = matrix(rows.column("x"))


class Best:
    """The k best (score from above, then tie) of each of m queries, and its kth score, -inf before there are k."""

    def __init__(self, m: int, k: int) -> None:
        self.k, self.kth = k, np.full(m, -np.inf)
        self.query = self.tie = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, query: np.ndarray, tie: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        mine = np.isin(self.query, touched)
        q, t, s = (np.concatenate([old[mine], new]) for old, new in ((self.query, query), (self.tie, tie), (self.score, score)))
        order = np.lexsort((t, -(np.unique(s, return_inverse=True)[1] if s.dtype == object else s), q))
        q, t, s = q[order], t[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        if s.dtype == object and self.kth.dtype != object:
            self.kth = self.kth.astype(object)
        self.kth[q[last]] = s[last]
        few = place < self.k
        self.query, self.tie, self.score = (np.concatenate([old[~mine], new[few]]) for old, new in ((self.query, q), (self.tie, t), (self.score, s)))

    def table(self, row: np.ndarray, w: np.ndarray, block: Candidates) -> pa.Table:
        """``row`` and ``w`` of the queries, with the candidates."""
        at = block.by_tie[self.tie]
        score = [int(s) for s in self.score] if self.score.dtype == object else self.score.astype(np.int64)
        columns = [pa.array(row[self.query], pa.int64()), pa.array(w[self.query], pa.int32()), block.id.take(pa.array(at, pa.int64())), pa.array(block.row[at], pa.int64()), pa.array(score, pa.int64())]
        return pa.table(columns, names=["row", "w", "id", "candidate", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks, with their ``rank``."""
    order = W.partitionBy("row", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
