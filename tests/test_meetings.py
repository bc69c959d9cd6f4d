"""Meetings of subjects in blocks and spans of late rows against brute force, and that queries shuffle no pair."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tracewright.catalog import QUERIES
from tracewright.operators import meetings
from tracewright.operators.intervals import span_of_each
from tracewright.operators.meetings import Valued, arrivals, by_blocks, overlaps, shared_cells, valued  # noqa: F401
from tracewright.plans.entities import _confidence

SF = "/root/testdata/sf0.001"
STAY = "subject long, visit long, device string, start long, end long"
SMALL = {"at_once": 7, "subjects": 4, "most": 40}


def stays(spark, seed, least=0):
    rng = random.Random(seed)
    rows = [(least + rng.randrange(14), k, rng.choice("de"), s := rng.randrange(300), s + rng.choice([0, 3, 40])) for k in range(90)]
    return rows, spark.createDataFrame(rows, STAY)


def told(m):
    return {"x": m.x, "y": m.y, "n": m.count(), "visits": m.count(m.new(m.a["visit"][m.i])), "first": m.fold(np.minimum, m.a["start"][m.i])}


OUT = "x long, y long, n long, visits long, first long"


def expected(a, b, met):
    found = {}
    for p in a:
        for q in b:
            if p[2] == q[2] and met(p, q):
                n, visits, first = found.get((p[0], q[0]), (0, set(), 10**9))
                found[p[0], q[0]] = n + 1, visits | {p[1]}, min(first, p[3])
    return sorted((*k, n, len(v), f) for k, (n, v, f) in found.items())


def test_two_kinds_in_blocks(spark):
    (a, left), (b, right) = stays(spark, 1), stays(spark, 2, 100)
    assert sorted(map(tuple, overlaps(left, right, 5, told, OUT, **SMALL).collect())) == expected(a, b, lambda p, q: p[3] - q[4] < 5 and q[3] - p[4] < 5)
    assert sorted(map(tuple, arrivals(left, right, 5, told, OUT, **SMALL).collect())) == expected(a, b, lambda p, q: abs(p[3] - q[3]) <= 5)


def test_each_two_subjects_meet_once(spark):
    a, df = stays(spark, 3)
    found = sorted((min(r.x, r.y), max(r.x, r.y), r.n) for r in overlaps(df, None, 5, told, OUT, **SMALL).collect())
    assert found == [(x, y, n) for x, y, n, *_ in expected(a, a, lambda p, q: p[0] < q[0] and p[3] - q[4] < 5 and q[3] - p[4] < 5)]


def test_shared_cells(spark):
    rows = sorted({(s, d, t // 50) for s, _, d, t, _ in stays(spark, 4)[0]})
    df = spark.createDataFrame(rows, "subject long, device string, cell long")
    fold = lambda x, y, n, shared: (lambda i, j: {"x": np.minimum(x[i], y[j]), "y": np.maximum(x[i], y[j]), "n": shared[i, j].astype(np.int64)})(*np.nonzero(shared))
    cells = {s: {r[1:] for r in rows if r[0] == s} for s, *_ in rows}
    found = shared_cells(df, None, fold, "x long, y long, n long", at_once=9, subjects=4, most=30)
    assert sorted(map(tuple, found.collect())) == sorted((x, y, len(cells[x] & cells[y])) for x in cells for y in cells if x < y and cells[x] & cells[y])


def test_confidence_is_rounded_as_sql_does(spark):
    pairs = [(s, n) for n in (7, 48, 160, 20_000, 16_000) for s in range(1, 200, 7)]
    df = spark.createDataFrame(pairs, "s long, n long").selectExpr("case when s >= 3 then round(s / n, 4) else -1.0 end as c")
    assert [float(r.c) for r in df.collect()] == _confidence(*np.array(pairs).T).tolist()


@pytest.mark.parametrize("earliest, reach", [(True, 0), (False, 6)])
def test_spans_swept_like_all_pairs(spark, earliest, reach):
    rng = random.Random(5)
    spans = [(rng.choice("de"), k % 17, a := rng.randrange(400), a + rng.choice([-2, 0, 2, 9, 90])) for k in range(60)]
    late = [(k, rng.choice("de"), rng.randrange(-20, 520)) for k in range(200)]
    found = span_of_each(spark.createDataFrame(late, "event_id long, device string, start_ns long"), spark.createDataFrame(spans, "device string, span long, a long, b long"), 50, reach, earliest)
    want = {}
    for e, d, t in late:
        far = [(max(a - t, t - b, 0), a, s) for x, s, a, b in spans if x == d and a <= b and max(a - t, t - b, 0) <= reach]
        if far:
            want[e] = min((f, a, s) if earliest else (f, s) for f, a, s in far)[-1], min(far)[0]
    assert {r.event_id: (r.span, r.dist) for r in found.collect()} == want


#: Queries of pairs, of which no join may make a row for each.
PAIRED = ["bound_faces", "owner_seed", "binding_queue", "co_present", "binding_confidence", "conversed_with", "first_time_pairs", "nearest_span", "late_attach", "unknown_clusters", "arrived_with_vehicle", "new_vehicle"]


@pytest.mark.parametrize("name", PAIRED)
def test_no_pair_is_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" in plan


@pytest.mark.parametrize("sparse", [16, 0])
@pytest.mark.parametrize("alone", [True, False])
def test_one_number_of_each_pair(spark, alone, sparse):
    """In tables and without, over intervals of which some end before they start."""
    odd = lambda rows: [(s, k, d, at, at - 30 if k % 5 == 0 else end) for s, k, d, at, end in rows]
    a, b = odd(stays(spark, 6)[0]), odd(stays(spark, 7, 100)[0])
    left, right = spark.createDataFrame(a, STAY), None if alone else spark.createDataFrame(b, STAY)
    fold = lambda m: {"x": np.minimum(m.x, m.y), "y": np.maximum(m.x, m.y), "n": m.values.astype(np.int64)}
    met = lambda p, q: (not alone or p[0] < q[0]) and p[3] - q[4] < 5 and q[3] - p[4] < 5
    want = {}
    for p in a:
        for q in a if alone else b:
            if p[2] == q[2] and met(p, q):
                want.setdefault((p[0], q[0]), []).append(max(p[3], q[3]))
    small = {"at_once": 7, "table": 20, "batch": 5, "sparse": sparse, "subjects": 4, "most": 40}
    first = valued(left, right, 5, lambda x, y: np.maximum(x["start"], y["start"]), np.minimum, fold, "x long, y long, n long", **small)
    assert sorted(map(tuple, first.collect())) == sorted((*k, min(v)) for k, v in want.items())
    often = valued(left, right, 5, lambda x, y: np.ones(len(x), bool), np.add, fold, "x long, y long, n long", **small)
    assert sorted(map(tuple, often.collect())) == sorted((*k, len(v)) for k, v in want.items())


@pytest.mark.parametrize("most", [16, 0])
def test_least_of_each_number(most):
    rng = np.random.default_rng(1)
    x, y, table = np.arange(5) * 3, np.arange(40) * 2, rng.integers(0, 4, (5, 40))
    want = sorted((x[i], y[j], v) for i in range(5) for v in range(1, 4) for j in np.flatnonzero(table[i] == v)[:2])
    assert sorted(zip(*Valued(x, y, table, 0).least(2, most), strict=True)) == want
    i, j = rng.permutation(np.stack(np.nonzero(table)), axis=1)
    at = meetings.least_of(2, x[i], y[j], table[i, j])
    assert sorted(zip(x[i][at], y[j][at], table[i, j][at], strict=True)) == want


def test_blocks_in_parts_and_several_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(meetings, "PACKED", 7)
    monkeypatch.setattr(meetings, "SIDE", 2)
    (a, left), (b, right) = stays(spark, 1), stays(spark, 2, 100)
    met = lambda p, q: p[3] - q[4] < 5 and q[3] - p[4] < 5
    assert sorted(map(tuple, overlaps(left, right, 5, told, OUT, **SMALL).collect())) == expected(a, b, met)
    found = sorted((min(r.x, r.y), max(r.x, r.y), r.n) for r in overlaps(left, None, 5, told, OUT, **SMALL).collect())
    assert found == [(x, y, n) for x, y, n, *_ in expected(a, a, lambda p, q: p[0] < q[0] and met(p, q))]


@pytest.mark.parametrize("name", ["co_present", "conversed_with", "arrived_with_vehicle", "new_vehicle", "binding_confidence", "first_time_pairs", "bound_faces", "owner_seed", "binding_queue"])
def test_no_row_is_copied_for_a_block(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan


def test_visits_of_a_vehicle_during_one_visit_count_once(spark, tmp_path):
    """A vehicle that comes twice, or late and long, during one visit is together with it once."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    seen = [(2, "d", 0, 4_000), (1, "d", 10, 5), (1, "e", 600, 1), (1, "d", 1_000, 9), (1, "e", 1_500, 1), (1, "d", 1_600, 5_000), (3, "d", 3_000, 5), (3, "e", 3_100, 1), (3, "d", 6_000, 1), (2, "e", 40_000, 5)]
    rows = [(k, at(s), u, d, float(n), "{}") for k, (u, d, s, n) in enumerate(seen)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.person, r.vehicle, r.together) for r in QUERIES["binding_confidence"](spark, str(tmp_path)).collect()] == [(2, 1, 1)]
