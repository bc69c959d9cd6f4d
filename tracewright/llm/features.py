"""Hashed n-gram counts of whole texts, and document frequencies of them over a whole corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts taken from an Arrow batch at a time.
TEXTS = 256
SPACE = 32
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def letters_table() -> np.ndarray:
    """For each code point of the basic plane its lower case if it is a letter, else a space."""
    out = np.full(1 << 16, SPACE, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Lower-cased letters of a text, each run of other characters as one space."""
    points = code_points(text)
    table = letters_table()
    low = table[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        low[i] = points[i] if chr(points[i]).isalpha() else SPACE
    gap = low == SPACE
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return low[keep]


def ngram_counts(symbols: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the hashed n-grams of a symbol sequence."""
    found = []
    for n in orders:
        if len(symbols) >= n:
            h = np.full(len(symbols) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ symbols[k : len(symbols) - n + 1 + k]) * _MIX[k]
            found.append((h ^ (h >> np.uint32(15))) * _MIX[0] >> np.uint32(32 - bits))
    return np.bincount(np.concatenate(found), minlength=1 << bits) if found else np.zeros(1 << bits, np.int64)


def crc_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(modulus).cast("long"))


def document_frequencies(texts: DataFrame, counts_of: Callable[[str], np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """In how many of ``texts(text)`` each feature occurs, and how many texts there are.

    Each task sums its own texts, so a task sends at most ``size`` numbers on, whatever the corpus holds."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                for text in batch.column(0).slice(k, TEXTS).to_pylist():
                    total[counts_of(text or "") > 0] += 1
                    n += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(total[there], n))], names=["feature", "n"])

    rows = texts.mapInArrow(sums, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(size, np.int64), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, n


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed, so that a feature in no text still has a weight."""
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and TF-IDF weights of unit length."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])).astype(np.float32) * idf[at]
    norm = float(np.sqrt((x * x).sum()))
    return at, x / norm if norm else x
