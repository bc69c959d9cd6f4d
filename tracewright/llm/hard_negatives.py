"""Hard-negative mining: rows of other labels whose scores lie in a window below each positive's, by norm-bucketed search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.shared import table, written
from tracewright.llm.whole_vectors import ASKED, FOUND, Best, Candidates, alike, best_of, block_rows, matrix, numbered, product

#: Norm buckets of a doubling of the norm; there are at most 2,048 doublings, so the list of buckets is bounded.
BANDS = 32
#: The first round searches the buckets of the greatest norms that hold this share of the rows, the second one the rest.
FIRST_SHARE = 1 / 16
#: A bound is missed only by more than this, so that rounded norms never prune a row that would count.
SLACK = 1 + 1e-9
#: Rows scored at a time: at first, and at most.
FIRST, MOST = 256, 2_048


def _search(k: int, same: bool):
    def found(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The best k rows of a block for each window of each anchor, longest rows first.

        A row of norm M scores at most |anchor| * M. What a window still needs is the greater of its lower limit and its
        running kth score; an anchor none of whose windows can get that from the next rows is done, as all rows behind
        them are shorter. (At a tie with the kth score a row of a smaller id counts, so only less prunes.)"""
        anchor_row = np.asarray(asked.column("row"))
        windows = asked.column("windows").combine_chunks()
        of = np.repeat(np.arange(len(asked)), np.asarray(windows.value_lengths()))
        w, lo, hi, kth = (windows.flatten().field(c) for c in ("w", "lo", "hi", "kth"))
        if not rows.num_rows:
            return Best(0, k).table(anchor_row, anchor_row, Candidates(rows))
        block = Candidates(rows)
        anchors, x = alike(matrix(asked.column("x")), block.x)
        number = lambda c, none: np.array([none if v is None else v for v in c.to_pylist()], x.dtype)
        lo, hi, kth = number(lo, -np.inf), number(hi, np.inf), number(kth, -np.inf)
        anchor_label, label = np.asarray(asked.column("label")), np.asarray(rows.column("label"))
        anchor_norm, norm = np.asarray(asked.column("norm")), np.asarray(rows.column("norm"))
        by_norm = np.argsort(-norm, kind="stable")
        best = Best(len(of), k)
        starts = np.searchsorted(of, np.arange(len(asked) + 1))
        for first in range(0, len(asked), ASKED):
            own = np.arange(starts[first], starts[min(first + ASKED, len(asked))])
            at, width = 0, FIRST
            while at < len(by_norm):
                new = by_norm[at : at + width]
                need = np.maximum(np.maximum(lo[own], kth[own]), best.kth[own]).astype(float)
                with np.errstate(invalid="ignore", over="ignore"):
                    own = own[~(need > anchor_norm[of[own]] * norm[new[0]] * SLACK)]
                if not len(own):
                    break
                need = np.maximum(np.maximum(lo[own], kth[own]), best.kth[own])
                mine, back = np.unique(of[own], return_inverse=True)
                scores = product(anchors[mine], x[new])[back]
                fits = (scores >= need[:, None]) & (scores <= hi[own][:, None]) & ((anchor_label[of[own]][:, None] == label[new]) == same) & (anchor_row[of[own]][:, None] != block.row[new])
                q, c = np.nonzero(fits)
                best.add(own[q], block.tie[new[c]], scores[q, c])
                at, width = at + width, min(2 * width, MOST)
        return best.table(anchor_row[of], np.asarray(w)[: len(of)], block)

    return found


def _dealt(anchors: DataFrame, windows: DataFrame, rows: DataFrame, k: int, same: bool, size: int) -> DataFrame:
    """The best k of ``rows`` for each window, by blocks of one norm bucket (and label, if ``same``).

    Only anchors with a window that the bucket's greatest norm may serve are sent to it."""
    key = F.col("label") if same else F.lit(0).cast("long")
    need = F.greatest(F.coalesce(F.col("lo").cast("double"), F.lit(float("-inf"))), F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    each = windows.groupBy("row").agg(F.collect_list(F.struct("w", "lo", "hi", "kth")).alias("windows"), F.min(need).alias("need"))
    asked = anchors.join(each, "row").select(key.alias("key"), "row", "x", "label", "norm", "windows", "need")
    long = lambda c: F.lit(c).cast("long")
    upto = lambda c: F.explode(F.sequence(long(0), F.col(c) - 1))
    part = lambda c, of: F.pmod(F.xxhash64(F.col(c), F.lit(of)), F.col(of))
    groups = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("groups"))
    buckets = rows.groupBy(key.alias("key"), "band").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("blocks"), F.max("norm").alias("longest"))
    near = buckets.join(groups, "key").join(asked, "key").where(~(F.col("need") > F.col("norm") * F.col("longest") * SLACK))
    left = near.select(F.col("key").alias("key"), F.col("band").alias("band"), "row", "x", "label", "norm", "windows", part("row", "groups").alias("group"), upto("blocks").alias("block"))
    dealt = rows.withColumn("key", key).join(buckets.join(groups, "key"), ["key", "band"])
    right = dealt.select("key", "band", "row", "id", "x", "label", "norm", part("row", "blocks").alias("block"), upto("groups").alias("group"))
    by = ["key", "band", "block", "group"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k, same), FOUND)


def searched(anchors: DataFrame, windows: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """For ``windows(row, w, lo, hi)`` of ``anchors``: the k best ``rows`` of the same label, or of others, whose score is
    from lo to hi (null: no limit), with their ``rank``.

    Buckets are searched in two rounds, the greatest norms first; in the second round each window's kth score so far
    prunes whole buckets before anything is dealt."""
    n = rows.count()
    size = block_rows(rows, n)
    bands = sorted(rows.groupBy("band").count().collect(), reverse=True)  # bounded, see BANDS
    split, held = None, 0
    for b in bands:
        held += b["count"]
        split = b["band"]
        if held >= n * FIRST_SHARE:
            break
    first = F.col("band") >= (0 if split is None else split)
    found = written(best_of(_dealt(anchors, windows.withColumn("kth", F.lit(None).cast("long")), rows.where(first), k, same, size), k))
    if held == n:
        return found
    kth = found.where(F.col("rank") == k).select("row", "w", F.col("score").alias("kth"))
    rest = _dealt(anchors, windows.join(kth, ["row", "w"], "left"), rows.where(~first), k, same, size)
    return written(best_of(found.drop("rank").unionByName(rest), k))


def hard_negatives(embeddings: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product with the anchor of components floor(256 * x). An anchor's positives are its best other rows
    of the same label, and their negatives the best rows of other labels with lower% <= score / positive's score <= upper%.
    Rows are bucketed by norm (and dealt into blocks of bounded bytes, so one common norm, label or vector fills no
    task); the Cauchy-Schwarz bound prunes buckets, and rows within one, that cannot reach a window's lower limit or
    its running kth score.

    Rows with a null ``label``, a null vector or null or non-finite components take no part; an empty vector scores 0
    with all, a shorter one counts as if zeros followed. Rows of the same id are rows of their own. Ties go to the smaller
    id, null ids last. A positive of a negative score has no negatives (the window is empty); one of score 0 has those
    of score 0. An anchor without another row of its label gives no rows. Scores are exact for components of any
    size, but one beyond a long counts as the end of the longs. Other columns, whatever their names, aren't read.
    """
    rows = numbered(embeddings, id_col, vec_col, label=label.cast("long"), anchor=F.coalesce(anchor, F.lit(False))).where("label is not null")
    doublings = F.when(F.col("norm") >= 1, F.log2(F.least(F.col("norm"), F.lit(1e308)))).otherwise(0.0)
    rows = rows.withColumn("band", F.floor(doublings * BANDS).cast("long"))
    anchors = rows.where("anchor").drop("anchor")
    none = F.lit(None).cast("long")
    chosen = searched(anchors, anchors.select("row", F.lit(0).alias("w"), none.alias("lo"), none.alias("hi")), rows, positives, True)
    chosen = chosen.select("row", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # ceil and floor of the score's percentages, in decimals
    share = "cast(positive_score as decimal(20, 0)) * {}"
    windows = chosen.where("positive_score >= 0").select("row", "w", F.expr(f"({share.format(lower)} + 99) div 100").alias("lo"), F.expr(f"{share.format(upper)} div 100").alias("hi"))
    found = searched(anchors, windows, rows, negatives, False).select("row", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(chosen, ["row", "w"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
