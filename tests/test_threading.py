"""Conversation threading: cases told apart by hand, and random streams against a sequential twin."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.operators import graphs, threading
from tracewright.operators.scratch import written
from tracewright.operators.threading import Threading, conversation_rows, matched, thread_conversations
from tracewright.operators.vectors import vector_sums
from tracewright.plans.conversations import sentences

S = 10**9
SCHEMA = "device long, id long, speaker string, start_ns long, end_ns long, embedding array<double>, prior string"


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def like(a, b):
    return None if a is None or b is None or len(a) != len(b) or not len(a) else float(a @ b)


def group_of_block(block, r):
    """Lists of utterances, one for each conversation of a block."""
    speakers = list(dict.fromkeys(u["speaker"] for u in block if u["speaker"] is not None))
    weight = Counter()
    for a, b in itertools.pairwise(block):
        if None not in (a["speaker"], b["speaker"]) and a["speaker"] != b["speaker"] and b["start"] - a["end"] <= r.reply_gap:
            sim = like(a["vec"], b["vec"])
            weight[frozenset((a["speaker"], b["speaker"]))] += r.reply if sim is not None and sim >= r.reply_like else r.stray
    for a, b in itertools.combinations(speakers, 2):
        sims = [s for x in block for y in block if x["speaker"] == a and y["speaker"] == b and (s := like(x["vec"], y["vec"])) is not None]
        if sims:
            mean = sum(sims) / len(sims)
            weight[frozenset((a, b))] += r.topic if mean >= r.attract else -r.topic if mean <= r.repel else 0
    groups = [{s} for s in speakers]
    for pair, w in weight.items():
        if w >= r.tie:
            hit = [g for g in groups if g & pair]
            groups = [g for g in groups if not g & pair] + [set().union(*hit)]
    found = sorted(([u for u in block if u["speaker"] in g] for g in groups), key=lambda g: g[0]["n"])
    if len(found) < 2 or min(map(len, found)) < r.least_utterances:
        return [block]
    if not r.by_topic_alone:
        spans = [(min(u["start"] for u in g), max(u["end"] for u in g)) for g in found]
        if any(a[0] >= b[1] or b[0] >= a[1] for a, b in itertools.combinations(spans, 2)):
            return [block]
    cross = [s for a, b in itertools.combinations(found, 2) for x in a for y in b if (s := like(x["vec"], y["vec"])) is not None]
    if cross and sum(cross) / len(cross) > r.most_alike:
        return [block]
    for u in block:
        if u["speaker"] is None:
            scores = []
            for g in found:
                vecs = [x["vec"] for x in g if x["vec"] is not None]
                topic = like(unit(sum(vecs)), u["vec"]) if vecs and u["vec"] is not None else 0.0
                gap = min(max(0, u["start"] - x["end"], x["start"] - u["end"]) for x in g) / S
                scores.append(0.6 * (topic or 0.0) + 0.4 / (1 + gap))
            found[scores.index(max(scores))].append(u)
    return found


def threaded(rows, rules=None):
    """(device, id, conversation, minted, turn) by plain loops over each device's sentences."""
    r = rules or Threading()
    out = []
    for device in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == device), key=lambda x: (x[3], x[1]))
        made = []
        for x in own:
            if made and made[-1]["speaker"] == x[2] and x[3] - made[-1]["end"] <= r.merge_gap:
                made[-1]["of"].append(x)
                made[-1]["end"] = max(made[-1]["end"], x[4])
            else:
                made.append({"speaker": x[2], "start": x[3], "end": x[4], "of": [x], "n": len(made)})
        for u in made:
            vecs = [np.array(x[5]) for x in u["of"] if x[5] is not None]
            u["vec"] = unit(sum(vecs) / len(vecs)) if vecs else None
        blocks = [[made[0]]]
        for a, b in itertools.pairwise(made):
            if b["start"] - a["end"] > r.block_gap:
                blocks.append([])
            blocks[-1].append(b)
        groups = [sorted(g, key=lambda u: u["n"]) for block in blocks for g in group_of_block(block, r)]
        groups.sort(key=lambda g: g[0]["n"])
        claims = sorted((-n, p, k) for k, g in enumerate(groups) for p, n in Counter(x[6] for u in g for x in u["of"] if x[6] is not None).items())
        name, used = {}, set()
        for _, p, k in claims:
            if k not in name and p not in used:
                name[k] = p
                used.add(p)
        for k, g in enumerate(groups):
            members = sorted((x for u in g for x in u["of"]), key=lambda x: (x[3], x[1]))
            turn, last = 0, None
            for x in members:
                if x[2] is not None:
                    turn += last is not None and last != x[2]
                    last = x[2]
                out.append((device, x[1], name.get(k, f"{device}:{members[0][1]}"), k not in name, turn))
    return Counter(out)


def said(device, number, speaker, start, end, topic, prior=None):
    return (device, number, speaker, start * S, end * S, None if topic is None else [float(k == topic) for k in range(4)], prior)


def dialogue(device, base, start, a, b, topic, prior=None, n=8):
    return [said(device, base + i, (a, b)[i % 2], start + 5 * i, start + 5 * i + 3, topic, prior) for i in range(n)]


def interleaved(device, rounds=4, step=24):
    out = []
    for k in range(rounds):
        for j, (who, at, topic) in enumerate([("1", 0, 0), ("2", 5, 0), ("3", 12, 1), ("4", 17, 1)]):
            out.append(said(device, 4 * k + j, who, k * step + at, k * step + at + 4, topic))
    return out


def thirds(device):
    """Three speakers on one topic are one conversation."""
    return [said(device, i, "abc"[i % 3], 4 * i, 4 * i + 3, 2) for i in range(12)]


CASES = {
    1: (dialogue(1, 0, 0, "a", "b", 0) + dialogue(1, 100, 600, "a", "b", 1), 2),  # a long silence
    2: (dialogue(2, 0, 0, "a", "b", 0) + dialogue(2, 100, 100, "a", "b", 0), 1),  # a pause
    3: (interleaved(3), 2),
    4: (dialogue(4, 0, 0, "a", "b", 0) + dialogue(4, 100, 45, "a", "b", 1), 1),  # topics in sequence
    5: ([said(5, 2 * k + j, w, 20 * k + 10 * j, 20 * k + 10 * j + 4, j) for k in range(3) for j, w in enumerate("ac")], 1),  # groups too small
    6: (interleaved(6) + [said(6, 500, None, 40, 42, 1)], 2),  # an unknown speaker on the second topic
    7: ([said(7, i, None, 4 * i, 4 * i + 3, 0) for i in range(6)], 1),  # all unknown
    8: (dialogue(8, 0, 0, "a", "b", 0, "old") + dialogue(8, 100, 600, "a", "b", 1, "old", 4), 2),  # one id claimed twice
    9: (dialogue(9, 0, 0, "a", "b", 0, "kept"), 1),
    10: (thirds(10), 1),
    11: ([said(11, i, w, a, b, 0) for i, (w, a, b) in enumerate([("x", 0, 2), ("x", 3, 5), (None, 6, 7), ("y", 8, 10), ("x", 11, 13)])], 1),
    12: (interleaved(12) + [said(12, 600 + i, "1", 400 + 10 * i, 403 + 10 * i, 1) for i in range(3)], 3),  # a speaker moves to the other topic after a silence
}


def test_cases(spark):
    rows = [x for own, _ in CASES.values() for x in own]
    df = spark.createDataFrame(rows, SCHEMA)
    found = thread_conversations(df)
    got = [tuple(r) for r in found.collect()]
    assert Counter(got) == threaded(rows)
    names = defaultdict(dict)
    for device, number, name, minted, turn in got:
        names[device][number] = (name, minted, turn)
    assert {d: len({v[0] for v in own.values()}) for d, own in names.items()} == {d: n for d, (_, n) in CASES.items()}
    assert names[6][500][0] == names[6][2][0] != names[6][0][0]
    assert {v[:2] for k, v in names[8].items() if k < 100} == {("old", False)} and {v[:2] for k, v in names[8].items() if k >= 100} == {("8:100", True)}
    assert {v[:2] for v in names[9].values()} == {("kept", False)}
    assert [names[11][k][2] for k in range(5)] == [0, 0, 0, 1, 2]
    catalogue = {(r.device, r.conversation): r for r in conversation_rows(df, found).collect()}
    assert catalogue[3, "3:0"].speakers == ["1", "2"] and catalogue[3, "3:2"].speakers == ["3", "4"] and catalogue[7, "7:0"].speakers == []
    assert catalogue[1, "1:0"].sentences == 8 and catalogue[1, "1:0"].end_ns == 38 * S
    # A second run over its own ids mints nothing and changes nothing.
    again = thread_conversations(df.drop("prior").join(found.select("device", "id", found.conversation.alias("prior")), ["device", "id"]))
    assert Counter((d, n, c, t) for d, n, c, _, t in map(tuple, again.collect())) == Counter((d, n, c, t) for d, n, c, _, t in got)
    assert not again.where("minted").count()
    assert not thread_conversations(df.limit(0)).collect()


@pytest.mark.parametrize("rules", [Threading(), Threading(least_utterances=2, most_alike=0.7, by_topic_alone=True)])
def test_random_streams_like_the_twin(spark, rules):
    draw = random.Random(5)
    rows = []
    for device in range(25):
        at, k = draw.randrange(100), 0
        topics = [unit(np.array([draw.gauss(0, 1) for _ in range(6)])) for _ in range(3)]
        while k < 60:
            at += draw.choice([0, 1, 1, 2, 4, 5, 6, 300, 301]) if draw.random() < 0.3 else draw.randrange(6)
            who = draw.randrange(5)
            vec = unit(topics[who % 3 if draw.random() < 0.85 else draw.randrange(3)] + 0.2 * np.array([draw.gauss(0, 1) for _ in range(6)]))
            length = draw.randrange(1, 6)
            rows.append((device, k, None if draw.random() < 0.15 else f"s{who}", at * S + draw.choice([0, 0, 1]), (at + length) * S, None if draw.random() < 0.1 else [float(x) for x in vec], draw.choice([None, "p", "q", f"p{who % 3}", f"{k // 20}"])))
            at, k = at + draw.randrange(length + 1), k + 1
    got = Counter(map(tuple, thread_conversations(spark.createDataFrame(rows, SCHEMA).repartition(7), rules).collect()))
    want = threaded(rows, rules)
    assert got == want
    assert len({(r[0], r[2]) for r in want}) > 40


def test_threads_of_the_tables(spark):
    from tracewright.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in ("device", "id", "speaker", "start_ns", "end_ns", "embedding", "prior")) for r in sentences(spark, sf).collect()]
    assert Counter(map(tuple, QUERIES["threads"](spark, sf).collect())) == threaded(rows)


def test_greedy_matching_like_a_sorted_loop(spark):
    draw = random.Random(6)
    claims = list({(draw.randrange(3), draw.randrange(12), draw.randrange(12)): draw.randrange(4) for _ in range(150)}.items())
    held, left, right = set(), set(), set()
    for (d, a, b), n in sorted(claims, key=lambda c: (-c[1], c[0][2], c[0][1])):
        if (d, a) not in left and (d, b) not in right:
            held.add((d, a, b))
            left.add((d, a))
            right.add((d, b))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*k, n) for k, n in claims], "d int, a int, b int, n int")
    assert {tuple(r)[:3] for r in matched(df, ["d", "a"], ["d", "b"], F.desc("n"), "b", "a").select("d", "a", "b").collect()} == held


def test_vector_sums(spark):
    draw = random.Random(7)
    rows = [(draw.choice([None, 1, 2, 2**60, 2**60 + 1]), draw.choice(["x", None, "y"]), None if draw.random() < 0.1 else [float(draw.randrange(9)) for _ in range(3)], float(draw.randrange(1, 4))) for _ in range(500)]
    rows += [(7, "x", [1.0, 2.0], 1.0), (7, "x", [1.0, 2.0, 3.0], 1.0), (7, "x", [1.0, 2.0, 4.0], 1.0), (8, "x", None, 1.0), (9, "x", [], 2.0)]
    want = defaultdict(lambda: [0.0, np.zeros(3)])
    for a, b, v, w in rows[:500]:
        if v is not None:
            want[a, b][0] += w
            want[a, b][1] += w * np.array(v)
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.a, r.b): (r.n, r.total) for r in vector_sums(spark.createDataFrame(rows, "a long, b string, v array<double>, w double").repartition(5), ["a", "b"], "v", F.col("w")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.pop((7, "x")) == (2.0, [2.0, 4.0, 7.0]) and got.pop((9, "x")) == (2.0, [])
    assert got == {k: (n, list(v)) for k, (n, v) in want.items()}


def test_no_side_of_a_join_goes_through_the_driver(spark, monkeypatch):
    """Written tables look small by their files, so that joins would send them whole to the driver."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(threading, "written", kept)
    monkeypatch.setattr(graphs, "written", kept)
    monkeypatch.setattr(threading, "settled", lambda make: kept(make()))
    s = written(sentences(spark, "/root/testdata/sf0.001"))
    rows = threading.conversation_rows(s, threading.thread_conversations(s))
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert rows.count() and any("SortMergeJoin" in p for p in plans)
    assert [p for p in plans if "BroadcastExchange" in p] == []
