"""Queries that SQL cannot express against sequential twins on the same rows."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np

from tracewright.catalog import QUERIES
from tracewright.functions.timeq import HOUR, SECOND
from tracewright.plans import alerts, detections, evaluation, footage, presence, relations
from tracewright.sources.driver_tables import read, sightings
from tracewright.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return Counter(map(tuple, QUERIES[name](spark, SF).collect()))


def by(items, key):
    out = defaultdict(list)
    for r in items:
        out[key(r)].append(r)
    return out


def test_journeys_and_adjacency(spark):
    journeys, steps = [], defaultdict(list)
    for subject, own in by(presence.visits(spark, SF).collect(), lambda r: r.subject).items():
        made = []
        for r in sorted(own, key=lambda r: (r.start_ns, r.end_ns, r.device)):
            if not made or r.start_ns - made[-1][-1][2] > relations.JOURNEY_GAP:
                made.append([[r.device, r.start_ns, r.end_ns]])
            elif made[-1][-1][0] == r.device:
                made[-1][-1][2] = max(made[-1][-1][2], r.end_ns)
            else:
                made[-1].append([r.device, r.start_ns, r.end_ns])
        for j in made:
            if len({h[0] for h in j}) > 1:
                journeys.append((subject, j[0][1], j[-1][2], ">".join(h[0] for h in j)))
                [steps[a[0], b[0]].append(b[1] - a[2]) for a, b in itertools.pairwise(j)]
    assert journeys and rows(spark, "journeys") == Counter(journeys)
    assert rows(spark, "camera_adjacency") == Counter((*k, len(gaps), min(gaps), max(gaps)) for k, gaps in steps.items())


def test_cooldowns(spark):
    sent = []
    for (rule, subject), own in by(alerts.matches(alerts.events(spark, SF), alerts.rules(spark)).collect(), lambda r: (r.rule, r.subject)).items():
        last = None
        for r in sorted(own, key=lambda r: (r.start_ns, r.event_id)):
            if last is None or r.start_ns - last >= r.cooldown * SECOND:
                sent.append((rule, subject, r.event_id))
                last = r.start_ns
    assert sent and rows(spark, "alert_cooldown") == Counter(sent)
    told = []
    for subject, own in by(sightings(spark, SF).collect(), lambda r: r.subject).items():
        last = None
        for r in sorted(own, key=lambda r: (r.start_ns, r.event_id)):
            if last is None or r.start_ns - last >= jobs.COOLDOWN:
                told.append((subject, r.event_id, r.start_ns))
                last = r.start_ns
    assert rows(spark, "stream_cooldown") == Counter(told)


def test_stream_sessions(spark):
    """Closed sessions: six hours of silence, and over before the last event less the watermark; the others stay open."""
    every = sightings(spark, SF).collect()
    mark, closed = max(r.start_ns for r in every) - 90 * SECOND, []
    for subject, own in by(every, lambda r: r.subject).items():
        at = sorted(r.start_ns for r in own)
        cuts = [0, *(i for i in range(1, len(at)) if at[i] - at[i - 1] >= 6 * HOUR), len(at)]
        closed += [(subject, j - i, at[i], at[j - 1]) for i, j in itertools.pairwise(cuts) if at[j - 1] + 6 * HOUR <= mark]
    assert closed and rows(spark, "stream_sessions") == Counter(closed)


def spans_of(own, breaks):
    spans, end = [], 0
    for r in sorted(own, key=lambda r: r.place):
        if not spans or breaks(spans[-1][-1], r) or abs(r.start_ns - end) > r.duration_ns:
            spans.append([r])
            end = r.start_ns + r.duration_ns
        else:
            spans[-1].append(r)
            end = max(end, r.start_ns + r.duration_ns)
    return spans


def test_timelines(spark):
    streams = by(footage._streams(spark, SF).collect(), lambda r: (r.media_type, r.device))
    ends = lambda s: (s[0].start_ns, max(r.start_ns + r.duration_ns for r in s), len(s))
    assert rows(spark, "timeline") == Counter((*k, *ends(s)) for k, own in streams.items() for s in spans_of(own, lambda a, b: b.session % 4 == 0))
    orders = {r.segment: r for r in footage._orders(spark, SF).collect()}
    want = Counter()
    for k, own in streams.items():
        for s in spans_of([r for r in own if r.session in orders], lambda a, b: orders[a.session].status != orders[b.session].status):
            own_status = orders[s[0].session].status
            errors = [f"e{orders[r.session].attempts}" for r in s if orders[r.session].status == "error"]
            want[(*k, *ends(s), own_status, errors[-1] if errors else None)] += 1
    assert rows(spark, "status_runs") == want


def test_word_error_rate(spark):
    text = {(r.conv_id, r.turn): r.text.split() for r in read(spark, SF, "conversations").collect()}
    want = Counter()
    for (c, t), x in text.items():
        if (c, t - 1) in text:
            y = text[c, t - 1]
            row = list(range(len(y) + 1))
            for i, w in enumerate(x, 1):
                new = [i]
                for j, v in enumerate(y, 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != v)))
                row = new
            want[(c, t, row[-1], round(row[-1] / max(1, len(x)), 6))] += 1
    assert want and rows(spark, "word_error_rate") == want


def test_boxes_levels_and_faces(spark):
    area = lambda p, q: max(0, min(p.x + p.w, q.x + q.w) - max(p.x, q.x)) * max(0, min(p.y + p.h, q.y + q.h) - max(p.y, q.y))
    kept = Counter()
    for frame, own in by(detections.boxes(spark, SF).collect(), lambda r: r.frame).items():
        best = []
        for r in sorted(own, key=lambda r: (-r.score, r.box)):
            if all((i := area(r, k)) <= detections.OVERLAP * (r.w * r.h + k.w * k.h - i) for k in best):
                best.append(r)
        kept.update((frame, r.box) for r in best)
    assert rows(spark, "best_boxes") == kept
    ticks = Counter((r.device, r.start_ns // (24 * HOUR), r.start_ns // HOUR) for r in sightings(spark, SF).collect())
    levels = Counter()
    for _, own in by(sorted(ticks), lambda k: k[:2]).items():
        level = calm = 0
        for k in own:
            target = 2 if ticks[k] >= 4 else 1 if ticks[k] >= 2 else 0
            if target >= level:
                level, calm = target, 0
            else:
                calm += 1
                if calm >= detections.CALM:
                    level, calm = level - 1, 0
            levels[(k[0], k[2], level)] += 1
    assert rows(spark, "load_levels") == levels


def test_speaker_assignment(spark):
    weeks = defaultdict(Counter)
    for r in sightings(spark, SF).collect():
        weeks[r.start_ns // (7 * 24 * HOUR)][r.device, r.subject % 6] += r.end_ns - r.start_ns
    got = by(QUERIES["speaker_assignment"](spark, SF).collect(), lambda r: r.week)
    assert len(weeks) > 2 and set(got) == set(weeks)
    for week, cells in weeks.items():
        sides = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
        few, many = sorted(sides, key=len)
        shared = lambda a, b: cells.get((a, b) if few is sides[0] else (b, a), 0)  # noqa: B023, E731
        best = max(sum(shared(a, b) for a, b in zip(few, p, strict=True)) for p in itertools.permutations(many, len(few)))
        own = got[week]
        assert sum(r.shared for r in own) == best and len({r.truth for r in own}) == len({r.found for r in own}) == len(own) == len(few)
        assert all(cells.get((r.truth, r.found), 0) == r.shared for r in own)


def test_best_assignment_of_many():
    draw = np.random.default_rng(0)
    for n, m in [(1, 1), (1, 5), (5, 1), (4, 6), (6, 4), (7, 7)]:
        gain = draw.integers(0, 9, (n, m))
        found = evaluation.best_assignment(gain)
        small = gain if n <= m else gain.T
        assert sum(gain[r, c] for r, c in found) == max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert len({r for r, _ in found}) == len({c for _, c in found}) == min(n, m)
    planted = draw.permutation(60)
    gain = draw.random((60, 60))
    gain[np.arange(60), planted] += 5
    assert sorted(evaluation.best_assignment(gain)) == [(i, int(j)) for i, j in enumerate(planted)]


def test_recluster(spark):
    edges = QUERIES["identity_edges"](spark, SF).collect()
    root = {x: x for r in edges for x in (r.a, r.b)}

    def find(x):
        return x if root[x] == x else find(root[x])

    for r in edges:
        x, y = sorted((find(r.a), find(r.b)))
        root[y] = x
    loosest = defaultdict(float)
    for r in edges:
        loosest[find(r.a)] = max(loosest[find(r.a)], r.distance)
    assert edges and rows(spark, "recluster") == Counter((x, find(x), loosest[find(x)]) for x in root)


def test_paragraph_chunks(spark):
    want = Counter()
    for r in read(spark, SF, "documents").where("text is not null").collect():
        chunks = []
        for p in (p for p in re.split("\n+", r.text) if p.strip(" ") != ""):
            if chunks and chunks[-1] + len(p) + 2 <= 1_200:
                chunks[-1] += len(p) + 2
            else:
                chunks.append(len(p))
        want.update((r.doc_id, i, n) for i, n in enumerate(chunks))
    assert want and rows(spark, "paragraph_chunks") == want
