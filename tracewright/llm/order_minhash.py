"""Near-duplicate classes by order MinHash over five-word shingles, each candidate verified by its shingles and by banded
alignment."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.features import TEXTS, code_points
from tracewright.llm.shared import components, written

#: Words in a shingle, and the least similarity of near-duplicates.
WORDS, SIMILAR = 5, 0.8
#: Sketches of a text, and the smallest labelled shingles that each keeps. Two texts that share the part J of their
#: shingles in order agree on a sketch with about J**KEPT: at J = 0.8 all SKETCHES miss with a chance of 3e-6, at
#: J = 0.6 with 4 %.
SKETCHES, KEPT = 24, 4
#: In buckets up to this size all pairs are candidates; a larger one is first linked to its most central text.
SMALL = 16
#: Words and shingles of texts that a verifying task remembers.
REMEMBERED = 4_000_000
#: Shingles that are known as frequent when the rarest of a text are sought.
FREQUENT = 65_536
#: Rarer shingles before one that are looked at to tell whether a pair has met.
BEFORE = 8

_ODD = np.random.default_rng(5).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _word_table() -> np.ndarray:
    """For each code point of the basic plane its lower case if it is a letter or digit, else 0."""
    out = np.zeros(1 << 16, np.uint64)
    for c in range(1 << 16):
        if chr(c).isalnum():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(size, np.uint64)
    up, down = ones * _P, ones * _P_INVERSE
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> np.ndarray:
    """A 64-bit hash for each word: maximal runs of letters and digits, lower-cased."""
    points = code_points(text)
    table = _word_table()
    low = table[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        low[i] = points[i] if chr(points[i]).isalnum() else 0
    inside = np.concatenate([[False], low > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(12, int(len(low)).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(low * up[: len(low)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashed: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words; a shorter text has one shingle of all its words."""
    n = min(WORDS, len(hashed))
    if not n:
        return hashed
    out = np.zeros(len(hashed) - n + 1, np.uint64)
    for k in range(n):
        out = (out + hashed[k : len(hashed) - n + 1 + k]) * _Q
    return _mixed(out)


def labelled(found: np.ndarray) -> np.ndarray:
    """Hashes of shingles with the number of their occurrence, so that repeats differ."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(found))
    times = np.empty(len(found), np.uint64)
    times[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return _mixed(found + times * _P)


def sketch(found: np.ndarray) -> np.ndarray:
    """For each of SKETCHES hash functions, one hash of the KEPT smallest labelled shingles in the order of the text."""
    names = labelled(found)
    kept = min(KEPT, len(names))
    keys = np.arange(SKETCHES, dtype=np.uint64)
    places = np.empty((SKETCHES, kept), np.int64)
    for j, odd in enumerate(_ODD):
        places[j] = np.sort(np.argpartition(names * odd, kept - 1)[:kept])
    for h in found[places].T:
        keys = (keys ^ h) * _Q
        keys ^= keys >> np.uint64(29)
    return keys


def needed(n: int, m: int) -> int:
    """The least common subsequence with which lengths n and m are SIMILAR: common / (n + m - common)."""
    return int(np.ceil(SIMILAR * (n + m) / (1 + SIMILAR) - 1e-9))


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches stay within ``band`` of the diagonal.

    Bit-parallel over a window of 2 * band + 1 places of ``a`` that moves along the diagonal: places that it leaves
    are settled and only counted, so the cost is that of the band, whatever the length."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    n, base, settled, rows = len(a), 0, 0, (1 << min(len(a), band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        if j > band and base < n:
            settled += 1 - (rows & 1)
            rows >>= 1
            base += 1
        end = min(n, j + band + 1)
        if end > base and j + band < n:
            rows |= 1 << (end - 1 - base)
        own = places.get(x)
        if own:
            match = 0
            for p in own[bisect_left(own, base) : bisect_left(own, end)]:
                match |= 1 << (p - base)
            common = rows & match
            rows = ((rows + common) | (rows - common)) & ((1 << max(0, end - base)) - 1)
    return settled + max(0, min(n, len(b) + band) - base) - rows.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the word sequences' alignment similarity is at least SIMILAR; exact, as no alignment that reaches it
    leaves the band of as many insertions and deletions as it may have."""
    n, m = len(a), len(b)
    if not n or not m:
        return False
    least = needed(n, m)
    if min(n, m) < least or len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < least:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    if head + tail >= least:
        return True
    band = n + m - 2 * least
    return head + tail + _aligned(a[head : n - tail], b[head : m - tail], band) >= least


def near(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two texts' words are near-duplicates: SIMILAR by their sorted labelled shingles x and y, common over all,
    and by the alignment of the words."""
    least = needed(len(x), len(y))
    if min(len(x), len(y)) < least or not len(x):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= least and similar(a, b)


SKETCHED = "row bigint, doc_id bigint, same binary, n bigint, keys array<bigint>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k in range(0, batch.num_rows, TEXTS):
            for text in batch.column(2).slice(k, TEXTS).to_pylist():
                hashed = words(text or "")
                if not len(hashed):
                    rows.append((None, 0, None))
                    continue
                found = shingles(hashed)
                rows.append((hashlib.blake2b(hashed.tobytes(), digest_size=16).digest(), len(hashed), sketch(found).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["row", "doc_id", "same", "n", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def read(row: int, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        own = seen.get(row)
        if own is None:
            if held > REMEMBERED:
                seen.clear()
                held = 0
            hashed = words(text or "")
            own = seen[row] = hashed, np.sort(labelled(shingles(hashed)))
            held += 2 * len(hashed)
        return own

    for batch in batches:
        out = []
        for k in range(0, batch.num_rows, TEXTS):
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(k, TEXTS).columns), strict=True):
                (wa, sa), (wb, sb) = read(a, x), read(b, y)
                if near(wa, wb, sa, sb):
                    out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those whose texts are similar; ``texts(row, text)`` holds at least all that are named."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    own = texts.join(named, "row", "left_semi")
    both = pairs.join(own.select(F.col("row").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(own.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(_verified, "a bigint, b bigint").distinct())


def _tokens(text: str | None) -> np.ndarray:
    return labelled(shingles(words(text or ""))).view(np.int64)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several texts of a batch hold, and how many of them."""
    for batch in batches:
        found, times = np.unique(np.concatenate([np.zeros(0, np.int64), *map(_tokens, batch.column(2).to_pylist())]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[times > 1]), pa.array(times[times > 1], pa.int64())], names=["two", "times"])


def _rarest(own: DataFrame) -> DataFrame:
    """For each text of ``own(id, class, text)`` the rarest of its n shingles, the rarest first, so many that two texts which
    share 0.8 of theirs share one: ``id, n, class, rarest``.

    Any order common to all texts is right; this one puts the FREQUENT most repeated shingles last."""
    counts = own.mapInArrow(_repeated, "two bigint, times bigint").groupBy("two").agg(F.sum("times").alias("times"))
    frequent = {r["two"]: r["times"] for r in counts.orderBy(F.desc("times"), "two").limit(FREQUENT).collect()}
    held = own.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                tokens = sorted(_tokens(text).tolist(), key=lambda t: (held.value.get(t, 0), t))
                out.append((len(tokens), tokens[: len(tokens) - int(np.ceil(SIMILAR * len(tokens) - 1e-9)) + 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in out], pa.int64()), batch.column(1), pa.array([r[1] for r in out], pa.list_(pa.int64()))], names=["id", "n", "class", "rarest"])

    return own.mapInArrow(rows, "id bigint, n bigint, class bigint, rarest array<bigint>")


def _close_lengths(a: str, b: str):
    return F.least(a, b) >= SIMILAR * F.greatest(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``row, doc_id, copy_id, class_id, kept``.

    Texts are sequences of words: lower-cased runs of letters and digits. Order MinHash over their five-word shingles
    proposes pairs. A pair is linked if its shingles are similar by 0.8 (common ones over all, repeats counted) and its
    words by 0.8 of c / (n + m - c) in a banded alignment, c being the longest common subsequence of n and m words; a
    class is what links reach. A pair whose shingles agree in order by 0.8 is always this similar, and is proposed with
    all but 3e-6 of certainty. ``copy_id`` is the smallest id with the same words, ``class_id`` the smallest of the class,
    and exactly one row of a class is kept: one of that id.

    Texts with the same words are one vertex, so copies make no pairs. Texts that agree on a sketch share a bucket. In
    a bucket of up to SMALL texts all pairs are candidates. In a larger one every text is compared with the most
    central one (the text whose buckets hold most), so a group of near copies costs in proportion to its size; what that
    leaves outside its class meets all texts of other classes in such buckets with which it shares one of its rarest
    shingles, as every pair that is similar by 0.8 does. So the size of a bucket decides how a similar pair is found, not
    whether it is. Nothing is capped.

    Null texts, empty texts and texts without a word link with nothing and are kept. Rows are told apart by
    ``row_col`` (a unique long that no failure changes, such as one that was written) or, without it, by a number that is
    written with them; so null and repeated ids are rows like others, and a null id comes after all ids. A null in other
    columns does not matter; they are ignored. No rows give no rows.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")
    texts = docs.select(number.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = written(texts) if row_col is None else texts
    found = written(texts.mapInArrow(_sketches, SKETCHED))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    copies = written(found.where("same is not null").groupBy("same").agg(F.min("row").alias("id"), first, F.first("n").alias("n"), F.first("keys").alias("keys")))
    rows = copies.select("id", "n", F.explode("keys").alias("key"))
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    members = written(rows.join(shared, "key"))

    one, two = F.struct("id", "n"), "(x, i) -> transform(slice(m, i + 2, size(m)), y -> named_struct('a', x.id, 'b', y.id, 'n', x.n, 'm', y.n))"
    small = members.where(F.col("held") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("m"))
    small = small.select(F.explode(F.flatten(F.expr(f"transform(m, {two})"))).alias("p")).select("p.*")
    large = members.where(F.col("held") > SMALL)
    central = written(large.groupBy("id").agg(F.sum("held").alias("central")))
    ranked = large.join(central, "id")
    middle = written(ranked.groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), "n")).alias("p")).select("key", (-F.col("p.minus")).alias("a"), F.col("p.n").alias("n")))
    star = large.join(middle.withColumnRenamed("n", "an"), "key").where("id <> a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), F.col("an").alias("n"), F.col("n").alias("m"))
    pairs = written(small.unionByName(star).where(_close_lengths("n", "m")).select("a", "b").distinct())
    edges = _verify(pairs, texts)
    linked = components(edges)

    # What a large bucket's central text has left outside its class meets texts of other classes in unsettled buckets
    # by its rarest shingles.
    classed = large.join(linked, "id", "left").select("key", "id", F.coalesce("component", "id").alias("class"))
    middles = middle.select("key", F.col("a").alias("id")).join(linked, "id", "left").select("key", F.coalesce("component", "id").alias("middle"))
    classed = written(classed.join(middles, "key"))
    unsettled = classed.where(F.col("class") != F.col("middle")).select("key").distinct()
    own = written(classed.join(unsettled, "key", "left_semi").select("id", "class").distinct())
    own = written(texts.select(F.col("row").alias("id"), "text").join(own, "id").select("id", "class", "text"))
    listed = written(_rarest(own))
    before = F.expr(f"slice(rarest, greatest(1, at - {BEFORE}), least(at - 1, {BEFORE}))")
    finer = listed.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("rarest")))).select("id", "n", "class", "at", F.expr("rarest[at - 1]").alias("two"), before.alias("before"))
    held = finer.groupBy("two", "class").agg(F.count(F.lit(1)).alias("held"))
    most = held.groupBy("two").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("held", "class")).alias("most")).where("classes > 1")
    finer = finer.join(written(most.select("two", F.col("most.class").alias("most"))), "two")
    outside = finer.where(F.col("class") != F.col("most")).select("two", *(F.col(c).alias(f"a_{c}") for c in ("id", "n", "class", "at", "before")))
    # A pair need be met only at the first shingle that it shares: not where it shares one shortly before, nor where too
    # few come after for a pair that shares none before.
    least = (F.col("a_n") + F.col("n")) * (SIMILAR / (1 + SIMILAR)) - 1e-9
    first = ~F.arrays_overlap("a_before", "before") & (1 + F.least(F.col("a_n") - F.col("a_at"), F.col("n") - F.col("at")) >= least)
    rest = outside.join(finer, "two").where((F.col("a_class") != F.col("class")) & ((F.col("class") == F.col("most")) | (F.col("a_id") < F.col("id"))) & _close_lengths("a_n", "n") & first)
    rest = written(rest.select(F.least("a_id", "id").alias("a"), F.greatest("a_id", "id").alias("b")).distinct())
    # What two texts can share at most: what their rarest shingles share, and all that comes after the last of these.
    both = rest.join(listed.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("rarest").alias("x")), "a").join(listed.select(F.col("id").alias("b"), "n", F.col("rarest").alias("y")), "b")
    both = both.withColumn("shared", F.array_intersect("x", "y")).withColumn("last", F.element_at("shared", -1))
    most_shared = F.size("shared") + F.least(F.col("a_n") - F.array_position("x", F.col("last")), F.col("n") - F.array_position("y", F.col("last")))
    rest = both.where(most_shared >= least).select("a", "b")
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        linked = components(edges.unionByName(_verify(rest, texts)))

    classed = copies.select("same", "id", "first").join(linked, "id", "left").select("same", "first", F.coalesce("component", "id").alias("class"))
    classed = classed.join(classed.groupBy("class").agg(F.min("first").alias("kept")), "class")
    classes = written(classed.select("same", F.col("first.doc_id").alias("copy_id"), F.col("kept.doc_id").alias("class_id"), F.col("kept.row").alias("kept_row")))
    out = found.select("row", "doc_id", "same").join(classes, "same", "left")
    alone = F.col("same").isNull()
    return out.select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("kept_row") == F.col("row"))).alias("kept"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
