"""Quality classifier: similarity-weighted nearest-neighbour voting over latent-semantic vectors of text form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.features import TEXTS, code_points, crc_remainder, document_frequencies, inverse_frequencies, ngram_counts, weighted

BITS, ORDERS = 12, (1, 2, 3)
#: Expected number of labelled texts that vote, chosen by a hash of the id, and the dimensions they are reduced to.
VOTERS, DIMENSIONS = 2_000, 48
#: Neighbours that vote, and how sharply a vote grows with the cosine.
NEIGHBOURS, SHARPNESS = 15, 12.0
#: Steps of each ratio that describes a text's repetitions; they follow the n-grams as features of their own.
STEPS = 16
RATIOS = 6
SIZE = (1 << BITS) + RATIOS * STEPS


@cache
def _form_table() -> np.ndarray:
    """For each code point of the basic plane its form: a lower-case or capital letter, a digit, or the sign itself."""
    out = np.empty(1 << 16, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        out[c] = 97 if s.islower() else 65 if s.isupper() or s.isalpha() else 48 if s.isdigit() else 32 if s.isspace() and s != "\n" else c if c < 128 else 126
    return out


def _ratios(text: str, forms: np.ndarray) -> list[float]:
    """Shares of the text, each 0 to 1: repeated words, repeated neighbours, repeated pairs and lines, signs, capitals."""
    words = text.split()
    pairs = list(zip(words, words[1:], strict=False))
    lines = text.split("\n")
    n = max(1, len(forms))
    letters = max(1, int(((forms == 97) | (forms == 65)).sum()))
    return [
        1 - len(set(words)) / max(1, len(words)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        1 - len(set(pairs)) / max(1, len(pairs)),
        1 - len(set(lines)) / max(1, len(lines)),
        int(((forms != 97) & (forms != 65) & (forms != 32)).sum()) / n,
        int((forms == 65).sum()) / letters,
    ]


def counts_of(text: str) -> np.ndarray:
    forms = _form_table()[np.minimum(code_points(text), 0xFFFF)]
    counts = np.zeros(SIZE, np.int64)
    counts[: 1 << BITS] = ngram_counts(forms, ORDERS, BITS)
    # A ratio is a feature of its step, as frequent as a tenth of the text's characters.
    for k, x in enumerate(_ratios(text, forms)):
        counts[(1 << BITS) + k * STEPS + min(STEPS - 1, int(x * STEPS))] = 1 + len(forms) // 10
    return counts


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    def vectors(self, counts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(counts), self.basis.shape[1]), np.float32)
        for i, c in enumerate(counts):
            at, x = weighted(c, self.idf)
            out[i] = x @ self.basis[at]
        return _unit(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosines = self.vectors([counts_of(t) for t in texts]) @ self.voters.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.exp(SHARPNESS * (np.take_along_axis(cosines, near, axis=1).astype(float) - 1))
        return np.clip((weights * self.labels[near]).sum(axis=1) / weights.sum(axis=1), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", voters: int = VOTERS) -> Model:
    """Learn from labelled rows whose crc32(id) mod 3 is not 1.

    Document frequencies cover all of ``docs``. About ``voters`` labelled texts, chosen by a hash of the id, become
    vectors: their TF-IDF rows in the space of the sample's leading singular vectors."""
    df, n = document_frequencies(docs.select(F.col(text_col).alias("text")), counts_of, SIZE)
    idf = inverse_frequencies(df, n)
    usable = labels.where((crc_remainder(F.col(id_col), 3) != 1) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    share = min(1.0, voters / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [weighted(counts_of(t), idf) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float32())), batch.column(1)], names=["at", "x", "y"])

    rows = texts.select("text", "y").mapInArrow(rows_of, "at array<bigint>, x array<float>, y double").toArrow()
    matrix = np.zeros((rows.num_rows, SIZE), np.float32)
    for i, (at, x) in enumerate(zip(rows.column(0), rows.column(1), strict=True)):
        matrix[i, np.asarray(at.values)] = np.asarray(x.values)
    order = np.lexsort(matrix[:, :64].T) if len(matrix) else np.zeros(0, int)
    matrix, y = matrix[order], np.asarray(rows.column(2).to_pylist(), float)[order]
    values, left = np.linalg.eigh(matrix @ matrix.T) if len(matrix) else (np.zeros(0), np.zeros((0, 0)))
    top = np.argsort(-values)[:DIMENSIONS]
    top = top[values[top] > 1e-6]
    basis = (matrix.T @ left[:, top] / np.sqrt(values[top])).astype(np.float32)
    return Model(idf, basis, _unit(matrix @ basis).astype(np.float32), y)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, 0 to 1, higher for better; a column of that name is replaced.

    A null text counts as empty; an empty text gets the vote of the voters nearest to a text of no characters. Without
    any labelled row every score is 0.5."""
    docs = docs.drop("quality_score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [held.value.scores([t or "" for t in texts.slice(k, TEXTS).to_pylist()]) for k in range(0, batch.num_rows, TEXTS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(vote, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
