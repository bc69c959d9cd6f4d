"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.features import SPACE, TEXTS, crc_remainder, document_frequencies, inverse_frequencies, letters, ngram_counts, weighted

BITS, ORDERS = 14, (1, 2, 3)
#: Expected number of labelled rows that the weights are fitted on, dealt evenly to the languages.
TRAIN_ROWS = 2_400
EPOCHS = 4
#: Follow the regularised leader: learning rate and its smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-3, 1e-3
UNKNOWN = "und"


def counts_of(text: str) -> np.ndarray:
    return ngram_counts(letters(text), ORDERS, BITS)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = weighted(counts, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        symbols = letters(text or "")
        if not self.langs or not (symbols != SPACE).any():
            return UNKNOWN, 0.0
        p = _softmax(self.logits(ngram_counts(symbols, ORDERS, BITS)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal over sparse rows (features, values, class); the last coordinate is the bias."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = _leader(z[at], n[at])
            error = _softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = _leader(z, n)
    return w[:size].astype(np.float32), w[size]


def _temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The divisor of the logits that gives held-back rows the greatest likelihood."""
    grid = np.geomspace(0.05, 5, 60)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(ys)), ys]).mean())

    return float(min(grid, key=loss)) if len(ys) else 1.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on rows whose crc32(id) mod 4 is not 2 and whose language is not null.

    Document frequencies cover all of these rows; the weights are fitted on about ``train_rows`` of them, as many for
    each language, chosen by a hash of the id. A fifth of the sample sets the temperature."""
    usable = docs.where((crc_remainder(F.col(id_col), 4) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    df, n = document_frequencies(usable.select("text"), counts_of, 1 << BITS)
    idf = inverse_frequencies(df, n)
    if not langs:
        return Model([], idf, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    each = max(1, train_rows // len(langs))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, each / sizes[lang])))
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("text", "lang")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*weighted(counts_of(t), idf), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float32())), pa.array([m[2] for m in made], pa.string())], names=["at", "x", "lang"])

    sample = chosen.mapInArrow(rows_of, "at array<bigint>, x array<float>, lang string").toArrow()
    rows = sorted(((np.asarray(a.values), np.asarray(x.values), langs.index(y.as_py())) for a, x, y in zip(*sample.columns, strict=True)), key=lambda r: (r[2], len(r[0]), r[1].tobytes()))
    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    w, b = _follow_the_leader(used, 1 << BITS, len(langs), EPOCHS)
    logits = np.array([x @ w[at] + b for at, x, _ in held]).reshape(len(held), len(langs))
    return Model(langs, idf, w, b, _temperature(logits, np.array([y for *_, y in held], int)))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; columns of these names are replaced.

    Null texts and texts without a letter give ``und`` and 0, as does a model that has seen no language."""
    docs = docs.drop("lang_pred", "lang_score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = held.value
            texts = batch.column(batch.schema.get_field_index(text_col))
            made = [own.predict(t) for k in range(0, batch.num_rows, TEXTS) for t in texts.slice(k, TEXTS).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
