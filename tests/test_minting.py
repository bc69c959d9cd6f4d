"""Match-or-mint, settling in order, similar sets and pruned neighbours against plain loops."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.operators import vectors
from tracewright.operators.minting import Minting, match_or_mint, minted_id
from tracewright.operators.settling import settled_in_order
from tracewright.operators.similar import similar_sets
from tracewright.operators.vectors import knn, knn_by_pivots
from tracewright.plans import matching

SF = "/root/testdata/sf0.001"
NEW, KNOWN = "id long, place long, vec array<double>, clean boolean, may_mint boolean", "id long, identity long, vec array<double>"


def assigned(new, known, rules):
    """(id, identity, decision) of each row in turn, which looks at all that came before."""
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    good = lambda v: v is not None and np.linalg.norm(v) > 0
    voters = [(i, identity, unit(v)) for i, identity, v in known if good(v)]
    founders = [(identity, unit(sum(x for _, j, x in voters if j == identity) / sum(j == identity for _, j, _ in voters))) for identity in {i for _, i, _ in voters}]
    out = []
    for i, _, v, clean, may in sorted(new, key=lambda r: (r[1], r[0])):
        if not good(v):
            out.append((i, None, "none"))
            continue
        x = unit(v)
        near = sorted((1 - float(x @ y), j, identity) for j, identity, y in voters)[: rules.neighbours]
        near = [n for n in near if n[0] <= rules.ceiling]
        found = None
        if len(near) >= rules.least_votes:
            votes = Counter(n[2] for n in near)
            (w, (n, d)), *rest = sorted(((k, (c, min(y[0] for y in near if y[2] == k))) for k, c in votes.items()), key=lambda t: (-t[1][0], t[1][1], t[0]))
            if n >= 0.6 * len(near) or (n >= -(-rules.neighbours // 3) and d <= rules.match and n >= (rest[0][1][0] if rest else 0) + 2):
                found = (d, w)
        if found is None and founders:
            found = min((1 - float(x @ y), identity) for identity, y in founders)
        if found and found[0] <= rules.match:
            made = "match" if clean and may else "attach"
        elif found and found[0] <= rules.attach:
            made = "attach"
        else:
            made = "mint" if clean and may else "none"
        identity = minted_id(i) if made == "mint" else None if made == "none" else found[1]
        if identity is not None:
            voters.append((i, identity, x))
        if made == "mint":
            founders.append((identity, x))
        out.append((i, identity, made))
    return Counter(out)


def crowd(seed, n, m, dim=6, centres=8, spread=0.5):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dim))
    at = lambda k: [float(x) for x in middle[k] + spread * draw.normal(size=dim)]
    known = [(i, int(k), at(k)) for i, k in enumerate(draw.integers(centres // 2, size=m))]
    new = [(1_000 + i, int(draw.integers(max(1, n // 2))), at(draw.integers(centres)), bool(draw.random() < 0.6), bool(draw.random() < 0.9)) for i in range(n)]
    return new + [(9_000, 3, None, True, True), (9_001, 3, [0.0] * dim, True, True)], known


@pytest.mark.parametrize("seed,n,m,first,at_once,listed,rules", [
    (1, 250, 60, 4_096, 200_000, None, Minting()), (2, 36, 0, 12, 0, 2, Minting(neighbours=4)), (3, 200, 30, 50, 300, 3, Minting(neighbours=3, ceiling=0.3, match=0.2, attach=0.35)), (4, 1, 0, 10, 0, None, Minting()),
])
def test_match_or_mint_like_one_after_the_other(spark, seed, n, m, first, at_once, listed, rules):
    new, known = crowd(seed, n, m)
    want = assigned(new, known, rules)
    got = match_or_mint(spark.createDataFrame(new, NEW).repartition(5), spark.createDataFrame(known, KNOWN), rules, first, at_once, listed)
    assert Counter(map(tuple, got.select("id", "identity", "decision").collect())) == want
    assert n < 50 or {r[2] for r in want} == {"match", "attach", "mint", "none"}


def test_match_or_mint_of_nothing(spark):
    none = spark.createDataFrame([], NEW)
    assert not match_or_mint(none, spark.createDataFrame([], KNOWN)).collect()
    assert [tuple(r) for r in match_or_mint(spark.createDataFrame([(1, 1, None, True, True)], NEW), spark.createDataFrame([], KNOWN)).collect()] == [(1, None, "none")]


@pytest.mark.parametrize("of", [matching.voices, matching.faces])
def test_identities_of_the_tables(spark, of):
    new, known = of(spark, SF)
    want = assigned([tuple(r) for r in new.collect()], [tuple(r) for r in known.select("id", "identity", "vec").collect()], Minting())
    assert Counter(map(tuple, match_or_mint(new, known).select("id", "identity", "decision").collect())) == want


@pytest.mark.parametrize("at_once", [0, 40, 100_000])
def test_settled_in_order_like_a_loop(spark, at_once):
    draw, items, links = random.Random(1), [], []
    for i in range(150):
        items.append((i, (i * 37) % 101, draw.randrange(5)))
    order = sorted(items, key=lambda r: (r[1], r[0]))
    for k, r in enumerate(order):
        links += [(r[0], order[draw.randrange(k)][0], draw.randrange(9)) for _ in range(draw.randrange(4)) if k] + [(r[0], None, 5)] * draw.randrange(2)
    decide = lambda own, own_links: (own["weight"] + sum(x["w"] + (x["sum"] or 0) for x in own_links) % 11, str(len(own_links)))
    want = {}
    for i, _, weight in order:
        own = [x for x in links if x[0] == i]
        want[i] = (weight + sum(w + (want[b][0] if b is not None else 0) for _, b, w in own) % 11, str(len(own)))
    got = settled_in_order(spark.createDataFrame(items, "item long, place long, weight long"), spark.createDataFrame(links, "item long, before long, w long"), decide, "sum long, n string", at_once)
    assert {r.item: (r.sum, r.n) for r in got.collect()} == want


def test_similar_sets_like_all_pairs(spark):
    draw = random.Random(2)
    rows = [(i, draw.sample("abcdefghijkl", draw.randrange(1, 10))) for i in range(120)] + [(500 + i, list("xyz")) for i in range(4)] + [(900, [])]
    for least in (0.3, 0.7, 1.0):
        want = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) for a, x in rows for b, y in rows if a < b and (x or y) and len({*x} & {*y}) / len({*x} | {*y}) >= least - 1e-9}
        got = similar_sets(spark.createDataFrame(rows, "id long, items array<string>"), least)
        assert {(r.a, r.b): r.similarity for r in got.collect()} == want and want


def test_pruned_neighbours_are_the_nearest(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 12))
    vecs = np.concatenate([centres[draw.integers(20, size=380)] + 0.1 * draw.normal(size=(380, 12)), np.repeat(centres[:1], 60, axis=0), draw.normal(size=(60, 12))])
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, v array<double>")
    a, b = df.select(F.col("id").alias("a"), F.col("v").alias("x")), df.select(F.col("id").alias("b"), F.col("v").alias("y"))
    told = lambda d: {(r.a, r.k): (r.b, round(r.distance, 9)) for r in d.collect()}
    plain, pairs = told(knn(a, b, 5, 4_096)), []
    # Copies are equally near up to rounding, which blocks do not share; distances are compared.
    pruned = told(knn_by_pivots(a, b, 5, 32, pairs))
    assert {k: v[1] for k, v in pruned.items()} == {k: v[1] for k, v in plain.items()}
    assert len(pairs) == 2 and sum(pairs) < 0.6 * 500 * 500
    assert told(knn_by_pivots(a, b, 5, 4_096)) == plain
    few = knn(a.where("a < 3").withColumn("a_at", F.col("a")), b.withColumn("b_at", F.lit(1)), None, 64, most=1.2, earlier=True)
    assert {(r.a, r.b) for r in few.collect()} == {(2, j) for j in range(500) if j != 2 and 1 - vecs[2] @ vecs[j] <= 1.2}


def test_healed_segments_like_edges_in_order(spark):
    from tracewright.catalog import QUERIES
    from tracewright.plans.identities import FAR, _neighbours
    from tracewright.sources.driver_tables import vectors

    edges = {(min(r.a, r.b), max(r.a, r.b), r.distance) for r in _neighbours(spark, SF).collect() if r.distance <= FAR}
    name = {r.vec_id: f"n{r.identity}" for r in vectors(spark, SF).collect() if r.identity is not None}
    root = {x: x for a, b, _ in edges for x in (a, b)} | {x: x for x in name}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = sorted((find(a), find(b)))
        if x != y and (x not in name or y not in name or name[x] == name[y]):
            root[y] = x
            if y in name:
                name[x] = name[y]
    assert Counter(map(tuple, QUERIES["healed_segments"](spark, SF).collect())) == Counter((x, find(x), name.get(find(x))) for x in root)


def test_keys_of_several_members_bring_few_sets_together(spark):
    """Sets of twelve of forty members share single rare ones all the time, but hardly three of their rarest six."""
    draw = random.Random(4)
    rows = [(i, draw.sample(range(40), 12)) for i in range(300)]
    rows += [(1_000 + i, [*items[:11], 99]) for i, items in rows[:40]]
    got = similar_sets(spark.createDataFrame(rows, "id long, items array<long>"), 0.7)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) >= 0.7 * len({*x} | {*y})}
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) >= 40
    assert "transform" in got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[1]


def test_neighbours_are_found_by_pieces(spark, monkeypatch):
    """Rows after the first piece are held against the kth so far; what cannot be compared hides nothing else."""
    from tracewright.operators import vectors

    assert -(-700_000 // vectors.block_size(700_000)) <= vectors.SPREAD  # what is copied grows with the vectors only
    x = np.random.default_rng(5).normal(size=(90, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[40:50] = x[:10]
    x[[7, 60]] = np.nan
    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr(vectors, "QUERIES", 32)
    a, b = (pa.table({"a" if s == "x" else "b": np.arange(90), s: list(x)}) for s in "xy")
    for k, most in ((5, None), (5, 0.05), (200, None)):
        far = 1 - x @ x.T
        want = []
        for i in range(90):
            near = [j for j in range(90) if j != i and np.isfinite(far[i, j]) and (most is None or far[i, j] <= most)]
            want += [(i, round(d, 9)) for d in sorted(far[i, near])[:k]]
        got = vectors._nearest(k, most, True, False)(a, b).to_pylist()
        assert sorted((r["a"], round(r["distance"], 9)) for r in got) == sorted(want)
        assert all(abs(far[r["a"], r["b"]] - r["distance"]) < 1e-9 for r in got)


def test_edges_of_clusters_are_made_once(spark):
    """The edges come from neighbours of all vectors, which are not to be found again for the ids and for the first round."""
    from tracewright.operators.graphs import named_clusters

    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.2), (4, 5, 0.3)], "a long, b long, distance double").mapInArrow(told, "a long, b long, distance double")
    names = spark.createDataFrame([(1, "x"), (4, "y")], "id long, name string")
    assert {(r.id, r.cluster, r.name) for r in named_clusters(edges, names).collect()} == {(1, 1, "x"), (2, 1, "x"), (3, 1, "x"), (4, 4, "y"), (5, 4, "y")}
    assert seen.value == 3


def test_similar_sets_broadcast_no_keys(spark):
    """Sets meet by a shuffle of their keys, and of those that share a key by chance hardly any is compared in full."""
    draw = random.Random(8)
    sets = {i: sorted(draw.sample(range(40), 14)) for i in range(300)}
    for i in range(0, 300, 10):
        sets[i + 1000] = sorted({*sets[i][1:], 99})
    found = similar_sets(spark.createDataFrame(list(sets.items()), "id long, items array<long>"), 0.7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "bit_count" in plan
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.7 * len({*sets[a]} | {*sets[b]}) - 1e-9}
    assert {(r["a"], r["b"]) for r in found.collect()} == want and len(want) >= 30


def test_surest_bindings_are_told_before_they_are_listed():
    from tracewright.plans.entities import _may_be_surest, _pairs_kept, _surest

    draw = np.random.default_rng(4)
    shared = draw.integers(0, 60, (80, 200)).astype(np.int32)
    n, x, y = draw.integers(60, 90, 80), np.arange(80) * 2 + 1, np.arange(200) * 2
    listed = []

    def keep(voice, face, n, shared):
        listed.append(len(voice))
        return _surest(50)(voice, face, n, shared)

    got = _pairs_kept(keep, _may_be_surest(50))(x, y, n, shared)
    want = _pairs_kept(_surest(50))(x, y, n, shared)
    assert all((got[c] == want[c]).all() for c in want) and len(got["voice"]) == 50
    assert listed[0] < 0.05 * np.count_nonzero(shared)
    few = np.where(shared > 57, shared, 1).astype(np.int32)
    assert all((_pairs_kept(_surest(5_000), _may_be_surest(5_000))(x, y, n, few)[c] == _pairs_kept(_surest(5_000))(x, y, n, few)[c]).all() for c in want)


@pytest.mark.parametrize("k, most, same, earlier", [(3, 0.55, True, False), (3, None, False, True), (None, 0.4, True, True), (400, None, True, False)])
def test_rough_products_lose_no_neighbour(monkeypatch, k, most, same, earlier):
    """Also of equal and of broken vectors, and those a hair apart; what is told is in double precision, and few pairs are made in it."""
    made, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: made.append(len(a[1])) or einsum(*a))
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 16))
    x[100:130] = x[:30] + draw.normal(size=(30, 16)) * 1e-9
    x[130:140] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[200, 3], x[201] = np.nan, 0
    at = draw.integers(0, 20, 300)
    table = lambda c, d, e: pa.table({c: pa.array(range(300), pa.int64()), d: pa.array(list(x), pa.list_(pa.float64())), e: pa.array(at)})
    found = vectors._nearest(k, most, same, earlier)(table("a", "x", "a_at"), table("b", "y", "b_at"))
    got = {}
    for a, b, d in zip(*(found.column(c).to_pylist() for c in ("a", "b", "distance")), strict=True):
        got.setdefault(a, []).append((d, b))
    for a in range(300):
        fits = [(1 - float(x[a] @ x[b]), b) for b in range(300) if not (same and a == b) and (not earlier or (at[b], b) < (at[a], a))]
        want = sorted(f for f in fits if np.isfinite(f[0]) and (most is None or f[0] <= most))[:k]
        assert np.allclose(sorted(d for d, _ in got.get(a, [])), [d for d, _ in want], atol=1e-14, rtol=0)
    assert k == 400 or 0 < sum(made) < 300 * 300 / 4
