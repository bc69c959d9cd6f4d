"""Scores of found results against ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import plate_key
from tracewright.functions.timeq import DAY, floor_div
from tracewright.plans.matching import _variants
from tracewright.registry import query
from tracewright.sources.driver_tables import SIGHTINGS_SQL, VECTORS_SQL, read, sightings, vectors


def word_errors(pairs: DataFrame, reference: str, found: str) -> DataFrame:
    """Adds ``errors`` and ``words``: word edit distance and the reference's words.

    Each word of a pair becomes one sign, so that the built-in distance of strings counts words."""
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
    every = F.array_distinct(F.concat("ref_words", "found_words"))
    # Signs from U+0100 on; a pair has far fewer different words than there are before the surrogates.
    sign = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position("every_word", w) + 255), 4, "0")), "UTF-16BE")
    coded = lambda c: F.array_join(F.transform(c, sign), "")
    told = pairs.withColumns({"ref_words": words(reference), "found_words": words(found)}).withColumn("every_word", every)
    told = told.withColumns({"errors": F.levenshtein(coded("ref_words"), coded("found_words")).cast("long"), "words": F.size("ref_words")})
    return told.drop("ref_words", "found_words", "every_word")


def pairwise_scores(df: DataFrame, key: str, truth: str, found: str) -> DataFrame:
    """Precision, recall and F1 of a clustering over pairs of rows, from the sizes of its cells: no pairs are made.

    A null cluster matches nothing. Without pairs to judge a score is 1."""
    pairs = lambda *by: df.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("n"))
    both = pairs(truth, found).select(F.col("n").alias("both")).crossJoin(pairs(found).select(F.col("n").alias("said"))).crossJoin(pairs(truth).select(F.col("n").alias("true")))
    p, r = F.when(F.col("said") > 0, F.col("both") / F.col("said")).otherwise(1.0), F.when(F.col("true") > 0, F.col("both") / F.col("true")).otherwise(1.0)
    return both.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


@query(
    "clustering_scores",
    f"""WITH {VECTORS_SQL}, x AS (SELECT vec_id, vec_id % 10 AS truth, identity FROM v), b AS (SELECT sum(n * (n - 1) / 2) AS n FROM (SELECT count(*) AS n FROM x WHERE identity IS NOT NULL GROUP BY truth, identity)),
s AS (SELECT sum(n * (n - 1) / 2) AS n FROM (SELECT count(*) AS n FROM x WHERE identity IS NOT NULL GROUP BY identity)), t AS (SELECT sum(n * (n - 1) / 2) AS n FROM (SELECT count(*) AS n FROM x GROUP BY truth))
SELECT round(b.n / s.n, 6) AS precision, round(b.n / t.n, 6) AS recall, round(2 * (b.n / s.n) * (b.n / t.n) / (b.n / s.n + b.n / t.n), 6) AS f1 FROM b, s, t""",
)
def clustering_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_scores(vectors(spark, sf_dir).withColumn("truth", F.col("vec_id") % 10), "vec_id", "truth", "identity")


@query("word_error_rate")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it in its conversation."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    scored = word_errors(t.join(before, ["conv_id", "turn"]), "text", "said")
    return scored.select("conv_id", "turn", "errors", F.round(F.col("errors") / F.greatest("words", F.lit(1)), 6).alias("rate"))


@query(
    "label_set_f1",
    """WITH t AS (SELECT o_orderkey % 50 AS w, list_distinct(list(o_orderpriority)) AS want, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS got FROM orders GROUP BY 1),
c AS (SELECT len(list_intersect(want, coalesce(got, []))) AS shared, len(want) AS n, len(coalesce(got, [])) AS m FROM t) SELECT round(avg(CASE WHEN n + m = 0 THEN 1.0 ELSE 2.0 * shared / (n + m) END), 6) AS f1, count(*) AS windows FROM c""",
)
def label_set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("w")).agg(F.collect_set("o_orderpriority").alias("want"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("got"))
    n = F.size("want") + F.size("got")
    return o.agg(F.round(F.avg(F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect("want", "got")) / n)), 6).alias("f1"), F.count(F.lit(1)).alias("windows"))


@query(
    "dominant_labels",
    """WITH c AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY o_custkey) AS total FROM c)
SELECT o_custkey, label, n, round(n / total, 6) AS purity FROM k WHERE k = 1""",
)
def dominant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("o_custkey").agg(F.max_by("label", F.struct("n", F.translate("label", "123456789", "987654321"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.select("o_custkey", "label", "n", F.round(F.col("n") / F.col("total"), 6).alias("purity"))


#: Bands of a metric's ratio to its baseline within which it counts as unchanged, fixed values by metric family.
BANDS = {"count": 0.0, "share": 0.03, "time": 0.20, "error": 0.05, "other": 0.10}


@query(
    "baseline_verdicts",
    """WITH m AS (SELECT o_orderpriority AS metric, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS base, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS now FROM orders GROUP BY 1)
SELECT metric, round(now / base - 1, 6) AS change, CASE WHEN abs(now / base - 1) <= 0.03 THEN 'pass' WHEN now > base THEN 'improved' ELSE 'fail' END AS verdict FROM m""",
)
def baseline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(of("F").alias("base"), of("O").alias("now"))
    change = F.col("now") / F.col("base") - 1
    return m.select("metric", F.round(change, 6).alias("change"), F.when(F.abs(change) <= BANDS["share"], "pass").when(change > 0, "improved").otherwise("fail").alias("verdict"))


@query(
    "event_count_match",
    "WITH n AS (SELECT event_type, count(*) FILTER (WHERE value >= 50) AS n FROM events GROUP BY 1) SELECT event_type, n, n >= 100 AND n <= 100000 AS matched FROM n",
)
def event_count_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("n"))
    return n.withColumn("matched", F.col("n").between(100, 100_000))


@query(
    "load_trend",
    "WITH d AS (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, count(*) AS y FROM events GROUP BY 1, 2) SELECT event_type, round(coalesce(regr_slope(y, x), 0), 6) AS slope, round(avg(y), 6) AS mean, coalesce(regr_slope(y, x), 0) <= 0.05 AS keeps_up FROM d GROUP BY 1",
)
def load_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of a day's events; a load that does not rise keeps up."""
    d = read(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("x")).agg(F.count(F.lit(1)).alias("y"))
    slope = F.coalesce(F.regr_slope("y", "x"), F.lit(0.0))
    return d.groupBy("event_type").agg(F.round(slope, 6).alias("slope"), F.round(F.avg("y"), 6).alias("mean"), (slope <= 0.05).alias("keeps_up"))


_CONTINGENCY = f"{SIGHTINGS_SQL}, c AS (SELECT device AS truth, subject % 6 AS found, CAST(sum(end_ns - start_ns) AS BIGINT) AS shared FROM s GROUP BY ALL)"


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each true speaker and each found one speak together."""
    return sightings(spark, sf_dir).groupBy(F.col("device").alias("truth"), (F.col("subject") % 6).alias("found")).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("shared"))


@query("diarization_purity", f"WITH {_CONTINGENCY}, m AS (SELECT found, max(shared) AS best, sum(shared) AS total FROM c GROUP BY found) SELECT round(sum(best) / sum(total), 6) AS purity, count(*) AS clusters FROM m")
def diarization_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = contingency(spark, sf_dir).groupBy("found").agg(F.max("shared").alias("best"), F.sum("shared").alias("total"))
    return m.agg(F.round(F.sum("best") / F.sum("total"), 6).alias("purity"), F.count(F.lit(1)).alias("clusters"))


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns paired so that their gains add up to the most, by shortest augmenting paths over reduced costs:
    cubic in the smaller side, so dozens of speakers are no more trouble than a handful."""
    if gain.shape[0] > gain.shape[1]:
        return [(r, c) for c, r in best_assignment(gain.T)]
    cost, (n, m) = -gain.astype(float), gain.shape
    row_price, column_price, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column = row, -1
        while at >= 0:
            if column >= 0:
                used[column] = True
            reduced = cost[at] - row_price[at] - column_price
            better = ~used & (reduced < least)
            least[better], back[better] = reduced[better], column
            step = np.where(used, np.inf, least).min()
            row_price[row] += step
            row_price[row_of[used]] += step
            column_price[used] -= step
            least[~used] -= step
            column = int(np.where(used, np.inf, least).argmin())
            at = row_of[column]
        while column >= 0:
            before = back[column]
            row_of[column] = row if before < 0 else row_of[before]
            column = before
    return [(int(r), c) for c, r in enumerate(row_of) if r >= 0]


def _assigned(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    truths, founds = sorted(cells.truth.unique()), sorted(cells.found.unique())
    gain = np.zeros((len(truths), len(founds)))
    gain[cells.truth.map(truths.index), cells.found.map(founds.index)] = cells.shared
    return pd.DataFrame([(*key, truths[r], int(founds[c]), int(gain[r, c])) for r, c in best_assignment(gain)], columns=["week", "truth", "found", "shared"])


@query("speaker_assignment")
def speaker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each week as a case: the assignment of found to true speakers that shares the most time."""
    week = floor_div(F.col("start_ns"), 7 * DAY).alias("week")
    cells = sightings(spark, sf_dir).groupBy(week, F.col("device").alias("truth"), (F.col("subject") % 6).alias("found")).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("shared"))
    return cells.groupBy("week").applyInPandas(_assigned, "week long, truth string, found long, shared long")


@query(
    "plate_recall",
    """WITH k AS (SELECT c_custkey AS id, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS plate FROM customer), e AS (SELECT * FROM k WHERE id % 40 = 0), r AS (SELECT plate, id % 3 + 1 AS reads FROM k WHERE id % 3 <> 0),
j AS (SELECT e.id, CAST(sum(r.reads) AS BIGINT) AS reads, min(levenshtein(e.plate, r.plate)) AS d FROM e JOIN r ON levenshtein(e.plate, r.plate) <= 1 GROUP BY e.id)
SELECT e.id, coalesce(reads, 0) AS reads, coalesce(reads >= 2, false) AS found FROM e LEFT JOIN j ON j.id = e.id""",
)
def plate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected plates that were read at least twice, one edit allowed; reads that may match share a variant."""
    k = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), plate_key(F.col("c_name")).alias("plate"))
    expected = k.where("id % 40 = 0").withColumn("variant", _variants("plate"))
    reads = k.where("id % 3 <> 0").select(F.col("plate").alias("said"), (F.col("id") % 3 + 1).alias("reads"), F.col("id").alias("read_id")).withColumn("variant", _variants("said"))
    near = expected.join(reads, "variant").where(F.levenshtein("plate", "said") <= 1).select("id", "read_id", "reads").distinct().groupBy("id").agg(F.sum("reads").alias("reads"))
    return k.where("id % 40 = 0").select("id").join(near, "id", "left").select("id", F.coalesce("reads", F.lit(0)).cast("long").alias("reads"), F.coalesce(F.col("reads") >= 2, F.lit(False)).alias("found"))


@query(
    "graph_assertions",
    f"""WITH {SIGHTINGS_SQL}, p AS (SELECT subject, string_agg(device, '>' ORDER BY start_ns, event_id) AS path, count(*) AS n FROM s GROUP BY subject),
h AS (SELECT subject, arg_min(hour, (-n, hour)) AS peak FROM (SELECT subject, (start_ns // 3600000000000) % 24 AS hour, count(*) AS n FROM s GROUP BY ALL) GROUP BY subject)
SELECT p.subject, regexp_matches(path, 'signup.*error.*purchase') AS subsequence, CAST(peak AS INTEGER) AS peak_hour, n BETWEEN 20 AND 80 AS in_count FROM p JOIN h USING (subject)""",
)
def graph_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject: whether its devices hold an ordered subsequence, its peak hour, and a count within bounds."""
    s, want = sightings(spark, sf_dir), F.array(*(F.lit(x) for x in ("signup", "error", "purchase")))
    path = s.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_ns", "event_id", "device"))), lambda r: r["device"]).alias("path"), F.count(F.lit(1)).alias("n"))
    met = F.aggregate("path", F.lit(0), lambda i, d: F.when(F.get(want, i) == d, i + 1).otherwise(i))
    hours = s.groupBy("subject", F.expr("(start_ns div 3600000000000) % 24").cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    peak = hours.groupBy("subject").agg(F.min_by("hour", F.struct((-F.col("n")).alias("n"), "hour")).alias("peak_hour"))
    return path.join(peak, "subject").select("subject", (met == 3).alias("subsequence"), "peak_hour", F.col("n").between(20, 80).alias("in_count"))
