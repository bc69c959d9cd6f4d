"""Exact top-k search by inner product: the threshold algorithm over sorted lists of each dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import table, written
from tracewright.llm.whole_vectors import ASKED, FOUND, Best, Candidates, alike, best_of, block_rows, matrix, numbered, product

#: Rows that are scored between two looks at the threshold: the first time, and at most.
FIRST, MOST = 256, 2_048


def _search(k: int):
    def found(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The threshold algorithm on one block of rows for one group of queries.

        Each dimension has a list of the rows sorted by its component; a query reads it from the top where its own
        component is positive and from the bottom where it is negative. Lists are read at the same depth for all
        queries of the group, so a row is met at the least depth at which it stands in any list, from either end.
        Rows met are scored in full (scoring one that a query's own ends would meet later does it no harm). What has not
        been met by depth t has components between the t-th values of each list, so its score is at most the threshold,
        the query's product with those; a query ends when its kth score is above it. At a tie with the threshold
        it goes on, since a row of a smaller id may yet come."""
        asked_row = np.asarray(asked.column("row"))
        if not len(asked_row) or not rows.num_rows:
            return Best(0, k).table(asked_row, asked_row, Candidates(rows))
        block = Candidates(rows)
        queries, x = alike(matrix(asked.column("x")), block.x)
        n, best = len(x), Best(len(queries), k)
        order = np.argsort(block.x, axis=0, kind="stable")
        depth = np.full(n, n)
        for d in range(order.shape[1]):
            depth[order[:, d]] = np.minimum(depth[order[:, d]], np.minimum(np.arange(n), np.arange(n)[::-1]))
        lists = np.zeros(x.shape, x.dtype)
        lists[:, : order.shape[1]] = np.take_along_axis(x[:, : order.shape[1]], order, axis=0)
        met = np.argsort(depth, kind="stable")
        for first in range(0, len(queries), ASKED):
            at = np.arange(first, min(first + ASKED, len(queries)))
            lo, width = 0, FIRST
            while lo < n and len(at):
                new = met[lo : lo + width]
                scores = product(queries[at], x[new])
                near = (scores >= best.kth[at][:, None]) & (asked_row[at][:, None] != block.row[new])
                q, c = np.nonzero(near)
                best.add(at[q], block.tie[new[c]], scores[q, c])
                lo, width = lo + width, min(2 * width, MOST)
                if lo < n:
                    t = depth[met[lo]]
                    positive = queries[at] * (queries[at] > 0)
                    threshold = product(np.hstack([positive, queries[at] - positive]), np.hstack([lists[n - 1 - t], lists[t]])[None])
                    at = at[best.kth[at] <= threshold[:, 0]]
        return best.table(asked_row, np.zeros(len(asked_row), np.int32), block)

    return found


def top_k(embeddings: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of the highest inner products for each row that fits ``asked``: ``query_id, rank, vec_id, score``.

    Components count as floor(256 * x). Rows are dealt into blocks by their number, whose size is bounded in bytes, and
    queries into groups of as many; each task runs the threshold algorithm for one group on one block's lists, and the
    blocks' k best are merged. So nothing whole is in one task, and a vector that is repeated however often is spread.

    Null vectors and those with null or non-finite components take no part; an empty vector has the score 0 with all, and a
    shorter one counts as if zeros followed. Rows of the same id are rows of their own: each is a query if its id is, and a
    candidate for the others. Ties go to the smaller id, rows with a null id coming last. Scores are exact, however
    large the components, but one beyond a long counts as the end of the longs. Other columns, whatever their names, aren't read.
    """
    rows = numbered(embeddings, id_col, vec_col, asked=F.coalesce(asked, F.lit(False)))
    n, queries = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    size = block_rows(rows, n)
    blocks, groups = max(1, -(-n // size)), max(1, -(-queries // size))
    part = lambda c, of: F.pmod(F.xxhash64(F.col(c), F.lit(of)), F.lit(of).cast("long"))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    left = rows.where("asked").select("row", "x", part("row", groups).alias("group")).withColumn("block", every(blocks))
    right = rows.select("row", "id", "x", part("row", blocks).alias("block")).withColumn("group", every(groups))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(_search(k), FOUND)
    ids = rows.where("asked").select("row", F.col("id").alias("query_id"))
    return best_of(written(found), k).join(ids, "row").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
