"""Source divergence, hard negatives and top-k search against brute force, with odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tracewright.llm import divergence, hard_negatives, queries, top_k, whole_vectors

DOCS = "doc_id long, text string, lang string, source string, n int, term string, p long, value long, item string, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 2, 3, "y", 4) for i, (t, lang, source) in enumerate(rows)], DOCS)


def divergent(rows, least, top=10):
    """Every formula over every term of every group."""
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, n = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        df[lang or ""].update(set(words(t)))
        n[lang or "", source or ""].update(words(t))
    out = []
    for lang in df:
        kept = sorted(t for t in df[lang] if df[lang][t] >= least)
        groups = sorted(s for own, s in n if own == lang)
        every = sum((n[lang, s] for s in groups), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(n[lang, s]) for s in groups}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        q = share(every)
        for s in groups:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s)
            terms = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pairs)]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms)]
    return Counter(out)


def test_divergence_like_every_pair(spark):
    draw = random.Random(3)
    words = ["Aa", "aA", "b", "é", "É", "ß", "漢字", "𝒳y", "z" * 300, "q7r", "don't", "\x7f", "[x]", "x y"]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(12))), draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", None, "é"])) for _ in range(300)]
    rows += [("hot words here " * 50, "en", "a")] * 200 + [(None, "en", "b"), ("", None, None), ("7 7 7", "fr", "only"), ("rare", "it", "a"), ("rare", "it", "b"), ("w " * 100_000, "en", "c")]
    got = divergence.divergence(documents(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = divergent(rows, 10)
    assert Counter(map(tuple, got.collect())) == want and {r[0] for r in want} == {"en", "de", "", "it"}
    assert {r for r in want if r[0] == "it"} == {("it", "a", "pair", "b", 0, 1), ("it", "b", "pair", "a", 0, 1)}
    # A sketch of few cells rules out less, never more.
    small = divergence.divergence(documents(spark, rows), least=3, top=4, bits=3)
    assert Counter(map(tuple, small.collect())) == divergent(rows, 3, 4)
    assert divergence.divergence(documents(spark, [])).count() == 0


def test_sketch_never_underestimates(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(" ".join(f"w{'abcdefghij'[int(c)]}" * 1 + "xyz"[draw.randrange(3)] for c in str(draw.randrange(10**6))), draw.choice("ab"), "s") for _ in range(400)]
    texts = divergence._texts(documents(spark, rows), "text", "lang", "source").repartition(5)
    monkeypatch.setattr(divergence, "HELD", 20)
    true = defaultdict(Counter)
    for t, lang, _ in rows:
        true[lang].update({w.encode() for w in t.split()})
    for bits in (2, 6, 12):
        sketch = divergence.document_sketch(texts, 10, bits)
        for lang, own in true.items():
            found = sketch[divergence._cells(lang, list(own), bits)].min(axis=1)
            assert all(f >= min(10, n) for f, n in zip(found, own.values(), strict=True))
    assert divergent(rows, 10) == Counter(map(tuple, divergence.divergence(documents(spark, rows), bits=4).collect()))


VECS = "vec_id long, embedding array<double>, label int, row long, id long, x string, norm double, score long, rank int, band int, w int, anchor int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, 2, "x", 3.0, 4, 5, 6, 7, 8) for i, v, c in rows], VECS)


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def score(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def best_rows(rows, k, step=50):
    """(query id, rank, id, score) of every query row."""
    good = [(i, w) for i, v, _ in rows if (w := whole(v)) is not None]
    out = []
    for q, (i, a) in enumerate(good):
        if i is not None and i % step == 0:
            found = sorted((-score(a, b), j is None, j or 0, c) for c, (j, b) in enumerate(good) if c != q)[:k]
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j, _) in enumerate(found)]
    return Counter(out)


def odd_vectors(dim, n, seed, scale=1.0):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in draw.normal(size=dim) * scale], int(draw.integers(3))) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(n // 2)]  # one vector that is very frequent
    rows += [(50, None, 1), (100, [0.0] * dim, 2), (9_000, [float("nan")] * dim, 1), (9_050, [float("inf")] * dim, 0), (9_100, [None] * dim, 0), (9_150, [], 1), (9_200, [1.0], 1)]
    return rows + [(None, rows[3][1], 0), (None, None, None), (200, rows[4][1], None), (200, rows[4][1], 2), (150, rows[50][1], 1), (-50, rows[9][1], 2)]


@pytest.mark.parametrize("dim,n,scale", [(1, 300, 1.0), (4, 700, 1.0), (16, 260, 0.01), (3, 120, 1e7), (3, 90, 1e200)])
def test_top_k_like_brute_force(spark, monkeypatch, dim, n, scale):
    monkeypatch.setattr(top_k, "block_rows", lambda rows, n: 64)
    monkeypatch.setattr(top_k, "FIRST", 4)
    monkeypatch.setattr(top_k, "MOST", 16)
    rows = odd_vectors(dim, n, dim, scale)
    got = top_k.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == best_rows(rows, 5)


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1)]
    assert top_k.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect() == [(0, 1, 1, 4 * 256 * 256)]
    for few in ([], rows[:1], [(1, [1.0], 1)], [(0, None, 1)]):
        assert top_k.top_k(vectors(spark, few), F.col("vec_id") % 50 == 0).count() == 0


def test_the_threshold_ends_a_search_early():
    """Rows far below the best few are not scored."""
    import pyarrow.compute as pc

    draw = np.random.default_rng(1)
    x = np.abs(draw.normal(size=(5_000, 4)))
    x[:10] += 50
    rows = pa.table({"row": np.arange(5_000), "id": np.arange(5_000), "x": pa.array(list(x))})
    seen = []
    real = top_k.product
    top_k.product = lambda a, b: seen.append(len(b)) or real(a, b)
    try:
        got = top_k._search(5)(rows.filter(pc.less(rows["row"], 3)).select(["row", "x"]), rows)
    finally:
        top_k.product = real
    assert len(got) == 15 and set(got["id"].to_pylist()) <= set(range(10)) and sum(seen) < 1_000


def mined(rows, positives=5, negatives=10):
    good = [(i, w, c) for i, v, c in rows if (w := whole(v)) is not None and c is not None]
    out = []
    for q, (i, a, c) in enumerate(good):
        if i is None or i % 100:
            continue
        scored = sorted((-score(a, b), j is None, j or 0, n) for n, (j, b, _) in enumerate(good) if n != q)
        own = [s for s in scored if good[s[3]][2] == c][:positives]
        for s, none, j, _ in own:
            top = [t for t in scored if good[t[3]][2] != c and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(i, None if none else j, k + 1, None if t[1] else t[2], -s, -t[0]) for k, t in enumerate(top)]
    return Counter(out)


@pytest.mark.parametrize("dim,n,scale,size", [(2, 400, 1.0, 64), (8, 900, 1.0, 50), (6, 700, 0.004, 5_000), (3, 200, 1e7, 64)])
def test_hard_negatives_like_brute_force(spark, monkeypatch, dim, n, scale, size):
    monkeypatch.setattr(hard_negatives, "block_rows", lambda rows, n: size)
    monkeypatch.setattr(hard_negatives, "FIRST", 4)
    monkeypatch.setattr(hard_negatives, "MOST", 16)
    draw = np.random.default_rng(dim)
    # Norms from tiny to large, so that buckets and rows are pruned, and copies of one row.
    rows = [(i, [float(f * x) for x in v], c) for (i, v, c), f in zip(odd_vectors(dim, n, n, scale)[:n], np.exp(draw.normal(size=n) * 2), strict=True)]
    rows += odd_vectors(dim, 60, 5, scale)[60:] + [(10_000 + i, rows[3][1], rows[3][2]) for i in range(200)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0, F.col("label"))
    assert Counter(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_few_and_no_rows(spark):
    ask = lambda rows: [tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0, F.col("label")).collect()]
    assert ask([]) == ask([(0, [1.0], 1)]) == ask([(0, [1.0], 1), (1, [0.5], 2)]) == ask([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]) == []
    assert ask([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 3.0], 2), (3, [1.0, 1.0], 2)]) == [(0, 1, 1, 2, 0, 0)]


def test_longest_buckets_go_first(spark):
    """The second round gets the kth scores of the first, so short rows are dealt to no anchor."""
    rows = [(i, [float(9 if i < 40 else 1), 0.0], 1) for i in range(400)]
    df = vectors(spark, rows)
    made = whole_vectors.numbered(df, "vec_id", "embedding", label=F.col("label").cast("long")).withColumn("band", F.floor(F.log2("norm") * hard_negatives.BANDS).cast("long"))
    anchors = made.where("id = 0")
    none = F.lit(None).cast("long")
    windows = anchors.select("row", F.lit(0).alias("w"), none.alias("lo"), none.alias("hi"), F.lit(9 * 9 * 256 * 256).cast("long").alias("kth"))
    short = hard_negatives._dealt(anchors, windows, made.where("norm < 300"), 5, True, 64)
    assert short.count() == 0
    assert [r.id for r in hard_negatives.searched(anchors, windows.drop("kth"), made, 5, True).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hard_negatives", "op13_top_k"])
def test_more_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_pii_trees_see_all_candidates(spark, monkeypatch):
    """The weights of what the trees are fitted on add up to all candidates that are not held back."""
    from pyspark.sql import functions as F

    from tracewright.llm import pii

    n, seen = 24_000, []

    class Told(pii.GBTClassifier):
        def fit(self, rows):
            seen.append(rows.agg(F.sum("weight")).first()[0])
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Told)
    match = F.when(F.col("id") % 2 == 0, F.concat(F.lit("aB3"), F.sha2(F.col("id").cast("string"), 256))).otherwise(F.lit("plain"))
    before = F.concat(F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "password: ").otherwise(" is "))
    rows = pii._described(spark.range(n).select(F.lit("token").alias("generator"), match.alias("match"), before.alias("before"), F.lit(" ").alias("after")))
    held = rows.where(F.pmod(F.xxhash64("before", "match"), F.lit(5)) == 0).count()
    assert pii.fit(rows) is not None and seen == [n - held] * 2 and held > 0
