"""Source divergence audit: which sources of a language use its terms unlike each other, by sketch-prefiltered counting."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.shared import table, written

#: Documents of a language that must hold a term for it to be kept.
LEAST_DOCS = 10
#: Ranks of terms that are listed for each group.
TERMS = 10
#: Rows of the count-min sketch, and the cells of each, as a power of two. A cell is a byte, so the sketch has 12 MiB,
#: whatever the corpus holds; with more rare terms than cells fewer of them are found out, and the result is the same.
DEPTH, BITS = 3, 22
#: Cells that are sent together.
SLICE = 1 << 13
#: Different terms of its groups that a task counts before it sends them on.
HELD = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Bytes to lower-cased term bytes; all that is in no term becomes a space.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _cells(lang: str, terms: list[bytes], bits: int) -> np.ndarray:
    """The cells of each term in the rows of the sketch laid end to end: terms x DEPTH."""
    h = pd.util.hash_array(np.array([*terms, None], object)[:-1], categorize=False)
    seed = pd.util.hash_array(np.array([lang], object), categorize=False)
    h = (h ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return ((h[:, None] * _ODD) >> np.uint64(64 - bits)).astype(np.int64) + (np.arange(DEPTH) << bits)


def _added(sketch: np.ndarray, cells: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Adds to the sketch; a cell stops at ``most``, so that it never has less than the true sum or ``most``."""
    where, at = np.unique(cells, return_inverse=True)
    sums = np.bincount(at.ravel(), weights=np.repeat(counts, cells.shape[1]))
    sketch[where] = np.minimum(sketch[where] + sums, most)


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def document_sketch(texts: DataFrame, least: int = LEAST_DOCS, bits: int = BITS) -> np.ndarray:
    """Count-min sketch of the document frequencies of ``texts(lang, source, text)``, by language and term.

    Each task fills a sketch of its own; slices with anything in them are dealt by their number and added. Cells stop at
    ``least``, which is all that is asked of them. The sum has DEPTH * 2**bits bytes, and only that comes to the driver."""
    size = DEPTH << bits

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(size, np.uint8)
        docs: dict[str, Counter] = defaultdict(Counter)

        def emptied() -> None:
            for lang, own in docs.items():
                _added(sketch, _cells(lang, list(own), bits), np.fromiter(own.values(), float, len(own)), least)
            docs.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                docs[lang].update(set(_terms(text.as_py())))
                if len(docs[lang]) > HELD:
                    emptied()
            if sum(map(len, docs.values())) > HELD:
                emptied()
        emptied()
        yield from _slices(sketch)

    def _slices(sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = min(SLICE, 1 << bits)
        for k in np.flatnonzero(sketch.reshape(-1, step).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sketch[k * step : (k + 1) * step].tobytes()], pa.binary())], names=["slice", "cells"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(cells, np.uint8)
                own[k] = np.minimum(own[k] + more.astype(np.uint16), least).astype(np.uint8) if k in own else more
        for k, cells in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["slice", "cells"])

    kind = "slice long, cells binary"
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(size, np.uint8)
    for r in texts.mapInArrow(filled, kind).repartition(tasks, "slice").mapInArrow(summed, kind).collect():
        k = r["slice"] * len(r["cells"])
        out[k : k + len(r["cells"])] = np.frombuffer(r["cells"], np.uint8)
    return out


def _counted(sketch, least: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the terms that the broadcast ``sketch`` doesn't rule out, by language, source and term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                terms, counts = list(own), np.fromiter(own.values(), np.int64, len(own))
                possible = np.flatnonzero(sketch.value[_cells(lang, terms, bits)].min(axis=1) >= least)
                for k in range(0, len(possible), 1 << 16):
                    chosen = possible[k : k + (1 << 16)]
                    there = [terms[i] for i in chosen]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(there)), pa.array([source] * len(there)), pa.array(there, pa.binary()), pa.array(counts[chosen]), pa.array([docs[lang, source][t] for t in there], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            n.clear()
            docs.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms, own = _terms(text.as_py()), n[lang, source]
                held -= len(own)
                own.update(terms)
                docs[lang, source].update(set(terms))
                held += len(own)
                if held > HELD:
                    yield from sent()
                    held = 0
        yield from sent()

    return rows


def kept_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, bits: int = BITS) -> DataFrame:
    """``lang, source, term, n, lang_n``: occurrences of each kept term in each source of a language that has it, and in all of it.

    A term is kept by a language if at least ``least`` of its documents hold it. The texts are read twice: for the
    sketch, then for the exact counts of the terms that may reach ``least``, which alone are shuffled. Tasks send their
    own sums by (lang, source, term), so another partial sum on the JVM's side would only copy them; these are added,
    then added by (lang, term), in part before that shuffle. So no frequent term meets in one task."""
    texts = _texts(docs, text_col, lang_col, source_col)
    sketch = docs.sparkSession.sparkContext.broadcast(document_sketch(texts, least, bits))
    counted = texts.mapInArrow(_counted(sketch, least, bits), "lang string, source string, term binary, n long, docs long")
    key = ["lang", "source", "term"]
    counts = written(counted.repartition(*key).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    sketch.destroy()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    return written(counts.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n"))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * terms)), exactly; null for no terms."""
    wide = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"if({terms} > 0, 1 + (cast(1000000000 as decimal(10, 0)) * ({wide(n)} + 2)) div ({wide(total)} + 2 * {wide(terms)}), null)")


def _far(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TERMS, bits: int = BITS) -> DataFrame:
    """How far the sources of a language are from each other, and the terms that mark each: ``lang, source, part, item, value, rank``.

    Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z are lower-cased. A share of a term in a
    group is p = 1 + floor(10**9 * (n + 2) / (N + 2V)) for its n occurrences there, N of all kept terms and V kept terms of
    the language, and the distance of two shares is floor((p - q)**2 / (p + q)). Part ``pair`` has for each source
    every other of its language and the sum of the distances over all kept terms. Part ``term`` has the ``top`` terms
    whose share is above the language's, by distance. Ranks go by value from above, then by the item's bytes.

    Sums over all terms come from the sparse counts: a source that lacks a term has the share of zero occurrences there,
    so the sum is that of a pair without any term, plus what the terms of either source change on its own (terms alike in
    share at once), plus what those that both have change together; only these last are joined, term by term.

    Null texts, languages and sources count as ''; ids aren't read, so repeated or null ones and repeated rows are
    documents like others. A group without terms takes part with no occurrences; a language without kept terms has pairs of
    value 0 and no term rows; a lone source has no pair rows; empty tables have no rows. Texts of any length are read
    whole. All arithmetic is exact; other columns, whatever their names, aren't read.
    """
    own = kept_counts(docs, text_col, lang_col, source_col, least, bits)
    of_lang = own.select("lang", "term", "lang_n").groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    groups = _texts(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    groups = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "lang_total"])
    groups = written(groups.withColumn("zero", _share("0", "total", "v")))
    priced = own.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total", "v"), "q": _share("lang_n", "lang_total", "v")})

    one = groups.select("lang", "source", "zero", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    pairs = one.join(other, "lang").where("source <> item")
    nothing = pairs.select("lang", "source", "item", F.expr(f"if(v > 0, v * {_far('zero', 'item_zero')}, 0L)").alias("value"))
    alike = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    alone = pairs.join(alike, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"k * ({_far('p', 'item_zero')} - {_far('zero', 'item_zero')})")).alias("value"))
    left = priced.select("lang", "term", "source", "p", "zero")
    right = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("zero").alias("item_zero"))
    change = f"{_far('p', 'r')} - {_far('p', 'item_zero')} - {_far('zero', 'r')} + {_far('zero', 'item_zero')}"
    together = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.expr(change)).alias("value"))
    swapped = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = nothing.unionByName(alone).unionByName(swapped(alone)).unionByName(together).unionByName(swapped(together))
    far = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    marks = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_far("p", "q")).alias("value"), F.lit("term").alias("part"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(order))
    return ranked(far).unionByName(ranked(marks).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, any_value(t.total) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(g.total, 0)::HUGEINT + 2 * v.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total::HUGEINT + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= 10
"""
