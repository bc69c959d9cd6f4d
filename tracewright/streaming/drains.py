"""Drains with a budget: each run takes the oldest rows beyond a mark, folds them into a stored table, and moves the mark.

A run writes the new table under its own number and then appends its mark; a run that ends before its mark is as if it had
not been, and the next one writes the same number again. So runs may be split and repeated as they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.timeq import SECOND
from tracewright.operators.edges import merged_edges
from tracewright.operators.scratch import folder, remove_path
from tracewright.plans.relations import _EDGE_COLUMNS, _told, sighted
from tracewright.registry import query
from tracewright.sources.driver_tables import SIGHTINGS_SQL

#: Rows of a run, and how long a row must be stored before it is taken: later rows of the same time may still come.
BUDGET, SETTLE = 5_000, 10 * SECOND
MARK = "number long, created_ns long, id long, rows long"


def mark_of(spark: SparkSession, place: str) -> tuple[int, int, int]:
    """The number of the last complete run (0 for none), and the time and id of the greatest row that it has taken."""
    try:
        marks = spark.read.schema(MARK).parquet(f"{place}/marks")
        last = marks.orderBy(F.desc("number")).first()
    except AnalysisException:
        last = None
    return (0, -(2**63), -(2**63)) if last is None else (last["number"], last["created_ns"], last["id"])


def table_of(spark: SparkSession, place: str) -> DataFrame | None:
    number = mark_of(spark, place)[0]
    return spark.read.parquet(f"{place}/table/{number}") if number else None


def drained_once(source: DataFrame, place: str, now_ns: int, fold: Callable[[DataFrame, DataFrame | None], DataFrame], budget: int = BUDGET, settle: int = SETTLE) -> int:
    """One run over ``source(created_ns, id, ...)``; returns the rows taken, 0 if there are none.

    Rows beyond the mark that were stored at least ``settle`` ago are taken in the order of their time and id, ``budget``
    of them at most. ``fold(rows, table)`` makes the new table from the one before (None at first). Ids must be unique. Rows
    stored later than the mark but with a time before it are never seen; ``settle`` has to be longer than that can be."""
    spark = source.sparkSession
    number, created, last = mark_of(spark, place)
    beyond = (F.col("created_ns") > created) | ((F.col("created_ns") == created) & (F.col("id") > last))
    rows = source.where((F.col("created_ns") <= now_ns - settle) & beyond).orderBy("created_ns", "id").limit(budget)
    end = rows.agg(F.max(F.struct("created_ns", "id")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not end["n"]:
        return 0
    # The rows are named by the mark that they end at, so what is folded is what the mark says, however often it is read.
    upto = (F.col("created_ns") < end["m"]["created_ns"]) | ((F.col("created_ns") == end["m"]["created_ns"]) & (F.col("id") <= end["m"]["id"]))
    taken = source.where(beyond & upto)
    table = spark.read.parquet(f"{place}/table/{number}") if number else None
    fold(taken, table).write.mode("overwrite").parquet(f"{place}/table/{number + 1}")
    spark.createDataFrame([(number + 1, end["m"]["created_ns"], end["m"]["id"], end["n"])], MARK).coalesce(1).write.mode("append").parquet(f"{place}/marks")
    if number > 1:
        remove_path(spark, f"{place}/table/{number - 1}")
    return end["n"]


def edges_folded(rows: DataFrame, table: DataFrame | None) -> DataFrame:
    """Edge states of the rows merged into those of the table."""
    new = rows.drop("created_ns", "id")
    return merged_edges(new if table is None else table.unionByName(new))


@query(
    "drained_edges",
    f"""WITH {SIGHTINGS_SQL}, m AS (SELECT max(start_ns) - {SETTLE} AS mark FROM s), o AS (SELECT *, 1 AS n, row_number() OVER (PARTITION BY subject, device ORDER BY start_ns DESC, event_id) AS k FROM s, m WHERE start_ns <= mark)
SELECT CAST(subject AS VARCHAR) AS src, device AS dst, {_EDGE_COLUMNS} FROM o GROUP BY subject, device""",
)
def drained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after runs with a budget of a third of the sightings each: those of all that had settled by the last of them."""
    rows = sighted(spark, sf_dir).withColumns({"created_ns": F.col("first_ns"), "id": F.element_at("evidence", 1)["event"]})
    total, now = rows.agg(F.count(F.lit(1)), F.max("created_ns")).first()
    place = folder(spark)
    while drained_once(rows, place, now, edges_folded, budget=total // 3 + 1):
        pass
    return _told(table_of(spark, place))
