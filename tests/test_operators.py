"""Operators against small literal cases and sequential twins."""

import random

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.functions.timeq import DAY, SECOND
from tracewright.operators.graphs import components
from tracewright.operators.intervals import band_join, coverage, overlap_join, visits_of_intervals, visits_of_points
from tracewright.operators.timelines import timeline_spans

BASE = 1_781_784_000 * SECOND


def points(spark, times):
    return spark.createDataFrame([("x", t) for t in times], "s string, at long")


def test_visits_of_points(spark):
    one = visits_of_points(points(spark, [BASE + 2 * i * SECOND for i in range(60)]), ["s"], "at", 120 * SECOND).collect()
    assert [(r.start_ns, r.end_ns, r.n) for r in one] == [(BASE, BASE + 118 * SECOND, 60)]
    two = visits_of_points(points(spark, [BASE + DAY, BASE, BASE + 2 * SECOND, BASE + DAY + 4 * SECOND]), ["s"], "at", 120 * SECOND).collect()
    assert sorted((r.start_ns, r.end_ns) for r in two) == [(BASE, BASE + 2 * SECOND), (BASE + DAY, BASE + DAY + 4 * SECOND)]
    equal = visits_of_points(points(spark, [0, 10, 21]), ["s"], "at", 10)
    assert equal.count() == 2 and visits_of_points(points(spark, []), ["s"], "at", 10).count() == 0


def test_visits_of_intervals_like_a_fold(spark):
    draw = random.Random(4)
    rows = [(s, i, draw.choice("ab"), t := draw.randrange(200), t + draw.randrange(30)) for s in range(20) for i in range(12)]
    want = []
    for s in range(20):
        open_ = None
        for _, _, d, a, b in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1])):
            if open_ and open_[0] == d and a - open_[2] <= 5:
                open_[2] = max(open_[2], b)
            else:
                open_ = [d, a, b]
                want.append((s, open_))
    df = spark.createDataFrame(rows, "subject int, event int, device string, start_ns long, end_ns long")
    got = visits_of_intervals(df, "subject", "device", 5, "event").collect()
    assert sorted((r.subject, r.device, r.start_ns, r.end_ns) for r in got) == sorted((s, *v) for s, v in want)


def test_joins_like_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice("xy"), t := draw.randrange(-100, 100), t + draw.randrange(25)) for i in range(80)]
    a = spark.createDataFrame(rows, "a_id int, d string, a_start long, a_end long")
    b = spark.createDataFrame(rows, "b_id int, d string, b_start long, b_end long")
    pairs = [(p, q) for p in rows for q in rows if p[1] == q[1]]
    strict = {(p[0], q[0]) for p, q in pairs if p[2] - q[3] < 3 and q[2] - p[3] < 3}
    found = overlap_join(a, b, ["d"], 3, 10).select("a_id", "b_id").collect()
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == strict
    near = band_join(a, b, ["d"], 7).select("a_id", "b_id").collect()
    assert sorted(map(tuple, near)) == sorted((p[0], q[0]) for p, q in pairs if abs(p[2] - q[2]) <= 7)


def test_coverage_and_timeline(spark):
    df = spark.createDataFrame([("v", 0, 30), ("v", 10, 20), ("v", 30, 40), ("v", 50, 50), ("v", 60, 70)], "k string, start_ns long, end_ns long")
    assert sorted((r.start_ns, r.end_ns) for r in coverage(df, ["k"]).collect()) == [(0, 40), (60, 70)]
    seg = spark.createDataFrame([(1, 1, 0, 0, 10, False), (1, 1, 1, 10, 10, False), (1, 1, 2, 20, 10, True)], "stream long, session long, seq long, start_ns long, duration_ns long, gap_before boolean")
    assert sorted((r.start_ns, r.end_ns, r.segments) for r in timeline_spans(seg, "stream", "session", "seq").collect()) == [(0, 20, 2), (20, 30, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)]


def test_components_of_a_long_path(spark):
    rounds = []
    path = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(20_000, 20_001), (30_000, 30_000), (None, 3)], "a long, b long"))
    got = components(path, at_once=200, rounds=rounds).collect()
    assert len(rounds) <= 8 and len(got) == 10_004
    assert {(r.id, r.component) for r in got} == {(i, 0) for i in range(10_001)} | {(20_000, 20_000), (20_001, 20_000), (30_000, 30_000)}


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.plate_key(F.lit(" ab-12 3c "))) == "AB123C"
    assert get(text.fold_confusables(F.lit("OIBSZG"))) == "018526"
    assert get(text.sentences(F.lit("Aaaa. Bbbb."))) == ["Aaaa.", "Bbbb."]
    assert get(text.packed_paragraphs(F.lit("aa\nbb\ncccc"), 6)) == ["aa\n\nbb", "cccc"]
    assert get(text.label_of_reply(F.lit("It is Positive."), ["positive", "negative"])) == "positive"
    assert abs(get(text.trigram_similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))) - 4 / 11) < 1e-9


def test_days_rebuilt_alone_give_the_sessions_of_the_whole_history(spark):
    import random

    from tracewright.plans.catalogues import rebuilt

    rng, day, gap = random.Random(4), 86_400 * 10**9, 3_600 * 10**9
    points = sorted((k, rng.randrange(0, 5 * day)) for k in ("a", "b") for _ in range(120)) + [("a", 2 * day - 1), ("a", 2 * day), ("a", 2 * day + gap), ("a", 2 * day + gap)]
    wanted, last = {}, {}
    for k, t in sorted(points):
        wanted[k, t // day] = wanted.get((k, t // day), 0) + (k not in last or t - last[k] > gap)
        last[k] = t
    got = {}
    for r in rebuilt(spark.createDataFrame(points, "device string, start_ns bigint"), "device", gap).collect():
        got[r["device"], r["day"]] = got.get((r["device"], r["day"]), 0) + r["first"]
    assert got == wanted


def test_a_rule_draft_tells_its_first_fault(spark):
    from tracewright.plans.catalogues import rule_fault

    hook = [("webhook", None)]
    drafts = [
        ("", "loud", 0, 9, [], 0, [], "name"), ("r", "loud", -1, 9, [], 0, [], "severity"), ("r", "info", 0, 1440, [9], 0, [], "minutes"), ("r", "info", 5, None, [9], 0, [], "one end"),
        ("r", "info", 5, 5, [9], 0, [], "no width"), ("r", "info", None, None, [0, 7], -1, [], "days"), ("r", "info", 9, 5, [6], -1, hook, "cooldown"), ("r", "info", 9, 5, [], 0, [("fax", None)], "channel"),
        ("r", "info", 9, 5, [], 0, hook, "url"), ("r", "critical", 9, 5, [], 0, [("webhook", "https://a"), ("feed", None)], None),
    ]
    d = spark.createDataFrame(drafts, "n string, s string, a int, b int, d array<int>, c int, ch array<struct<kind: string, url: string>>, wanted string")
    assert [r.fault for r in d.select(rule_fault(*(d[c] for c in ("n", "s", "a", "b", "d", "c", "ch"))).alias("fault")).collect()] == [x[-1] for x in drafts]


def test_spans_of_random_streams_like_a_fold(spark):
    """Steps back, jumps, marked gaps and changes of status, with the two literal cases of a scrub bar."""
    import random

    from tracewright.operators.timelines import status_intervals, timeline_spans

    draw, rows = random.Random(8), []
    for stream in range(40):
        at = 0
        for k in range(draw.choice([1, 2, 30, 80])):
            length = draw.choice([0, 1, 5, 20])
            at += draw.choice([0, length, 1, -1, -30, 40, 6])
            rows.append((stream, stream % 3, k, at, length, draw.random() < 0.05, draw.choice(["done", "done", "done", "error", None]), draw.choice([None, f"e{k}"])))
            at += length
    rows += [(90, 0, 0, 0, 10, False, "done", None), (90, 0, 1, 10, 10, False, "done", None), (90, 0, 2, 20, 10, True, "done", None)]
    rows += [(91, 0, 0, 0, 30, False, "done", None), (92, 0, 0, 10, 10, False, "done", None)]

    def folded(by_status):
        spans = []
        for r in sorted(rows):
            last = spans[-1] if spans else None
            if last and last[0][:2] == r[:2] and not r[5] and abs(r[3] - last[1]) <= r[4] and not (by_status and last[0][6] != r[6]):
                last[1], last[2], last[3] = max(last[1], r[3] + r[4]), last[2] + 1, r[7] or last[3]
            else:
                spans.append([r, r[3] + r[4], 1, r[7]])
        return sorted(((r[0], r[1], r[3], end, n) + ((r[6], error) if by_status else ()) for r, end, n, error in spans), key=repr)

    df = spark.createDataFrame(rows, "stream int, session int, n int, start_ns long, duration_ns long, gap_before boolean, status string, last_error string").repartition(5)
    assert sorted(map(tuple, timeline_spans(df, "stream", "session", "n").collect()), key=repr) == folded(False)
    assert sorted(map(tuple, status_intervals(df, "stream", "session", "n").collect()), key=repr) == folded(True)
    assert [r for r in folded(False) if r[0] >= 90] == [(90, 0, 0, 20, 2), (90, 0, 20, 30, 1), (91, 0, 0, 30, 1), (92, 0, 10, 20, 1)]
    assert not timeline_spans(df.limit(0), "stream", "session", "n").collect()


def test_named_clusters_like_edges_in_order(spark):
    import random

    from tracewright.operators.graphs import named_clusters

    for seed, n, m, kinds, steps in [(1, 40, 60, 3, 5), (2, 200, 300, 30, 1000), (3, 300, 290, 2, 2), (4, 60, 500, 60, 50), (5, 80, 79, 4, 0)]:
        draw = random.Random(seed)
        edges = [(draw.randrange(n), draw.randrange(n), float(draw.randrange(steps))) for _ in range(m)] if steps else [(i, i + 1, float(i)) for i in range(m)]  # the last is one chain
        names = [(i, f"n{draw.randrange(kinds)}") for i in range(n + 3) if draw.random() < 0.2]
        root, name = list(range(n + 3)), {}
        for i, x in names:
            name[i] = min(x, name.get(i, x))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for _, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in edges):
            x, y = sorted((find(a), find(b)))
            if x != y and (name.get(x) is None or name.get(y) is None or name[x] == name[y]):
                root[y] = x
                if x in name or y in name:
                    name[x] = name.get(x) or name[y]
        wanted = {i: (find(i), name.get(find(i))) for i in {*(x for a, b, _ in edges if a != b for x in (a, b)), *(i for i, _ in names)}}
        made = named_clusters(spark.createDataFrame([*edges, (None, 1, 0.0), *edges[:5]], "a int, b int, distance double"), spark.createDataFrame(names, "id int, name string"))
        assert {r.id: (r.cluster, r.name) for r in made.collect()} == wanted
    none = spark.createDataFrame([], "a int, b int, distance double")
    assert not named_clusters(none, spark.createDataFrame([], "id int, name string")).collect()


def test_quality_ladders(spark):
    from tracewright.plans.detections import face_quality, plate_quality

    c = F.col
    plates = [(0.4, 0.9, 40.0, 7, "reject"), (0.9, 0.2, 40.0, 7, "reject"), (0.9, 0.9, 40.0, 3, "reject"), (0.9, 0.9, 10.0, 7, "reject"), (0.9, 0.6, 40.0, 7, "attach_only"), (0.9, 0.9, 40.0, 7, "mint"), (0.5, 0.8, 24.0, 4, "mint")]
    df = spark.createDataFrame(plates, "det double, conf double, px double, len int, want string")
    assert all(r.got == r.want for r in df.select("want", plate_quality(c("det"), c("conf"), c("px"), c("len"), (0.5, 0.4, 0.8, 24.0, 4)).alias("got")).collect())
    faces = [(0.5, 200.0, 90.0, "reject"), (0.9, 50.0, 90.0, "reject"), (0.9, 200.0, 20.0, "reject"), (0.7, 200.0, 90.0, "attach_only"), (0.9, 100.0, 90.0, "attach_only"), (0.9, 200.0, 40.0, "attach_only"), (0.9, 120.0, 45.0, "mint")]
    df = spark.createDataFrame(faces, "det double, px double, sharp double, want string")
    assert all(r.got == r.want for r in df.select("want", face_quality(c("det"), c("px"), c("sharp"), (0.6, 80.0, 30.0)).alias("got")).collect())
