"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's input.

Rows with null or repeated ids are documents like others in every stage: the stages choose rows, not ids.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import exact_dedup, langid, mixing, order_minhash, packing
from tracewright.llm.shared import settled, written

#: Documents whose best language has less than this calibrated probability are rejected, with those that have no letter.
LEAST_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language cannot be told."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE)).drop("lang_pred", "lang_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the longest (then smallest id, a null id last) stays."""
    return exact_dedup.deduplicated(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, since ids may be null or repeat, and the number's name."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id (a null id last)."""
    rows, name = _numbered(docs)
    kept = settled(lambda: order_minhash.near_duplicates(rows, row_col=name).where("kept").select(F.col("row").alias(name)))
    # The kept rows grow with the corpus, so they are shuffled, never broadcast.
    return rows.join(kept.hint("shuffle_hash"), name, "left_semi").drop(name)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, in which blocks of the sources follow their target weights."""
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, in the order in which the files of the stage before hold the documents, so
    that sequences follow the mixture. A table that is no file is taken in the order of its partitions."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return packing.pack(docs)
    return packing.pack(placed, place=("file", "row"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("packing", pack)]

#: Language ID and packing have no SQL; a test follows what language ID keeps through the other stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
