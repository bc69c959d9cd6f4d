"""Stored tables, drains and open tails: written twice, split into runs and started again they hold the same."""

import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.functions.timeq import SECOND
from tracewright.operators import stores
from tracewright.operators.edges import KEYS, merged_edges, observed, renamed
from tracewright.streaming import drains, tails

DAY = 86_400 * SECOND
ROWS = "id long, key long, start_ns long, value long"


def listed(df):
    return Counter(map(tuple, df.collect()))


def test_months_are_replaced_by_key_and_dropped_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(i, i % 30, (i % 100) * DAY, i) for i in range(600)]
    df = stores.with_month(spark.createDataFrame(rows, ROWS))
    stores.write_months(df, path)
    assert stores.months_of(spark, path) == ["1970-01", "1970-02", "1970-03", "1970-04"]
    back = lambda: listed(stores.read_months(spark, path, df.schema).select("id", "key", "start_ns", "value"))
    assert back() == Counter(rows)
    # Key 3 moves to May, where it is alone; key 5 has fewer rows; key 99 is new.
    new = [(1000, 3, 130 * DAY, 7), (1001, 5, 31 * DAY, 8), (1002, 99, 0, 9)]
    want = Counter([r for r in rows if r[1] not in (3, 5)] + new)
    for _ in range(2):
        stores.replace_keys(stores.with_month(spark.createDataFrame(new, ROWS)), path, "key")
        assert back() == want and "1970-05" in stores.months_of(spark, path)
    moved = [(1000, 3, 0, 7)]
    stores.replace_keys(stores.with_month(spark.createDataFrame(moved, ROWS)), path, "key")
    assert stores.months_of(spark, path) == ["1970-01", "1970-02", "1970-03", "1970-04"]
    assert stores.drop_months(spark, path, "1970-03") == ["1970-01", "1970-02"]
    assert back() == Counter(r for r in [*want, *moved] if r[2] >= 59 * DAY and r[0] != 1000)
    assert stores.drop_months(spark, path, "1970-03") == [] and stores.months_of(spark, f"{path}/none") == []


def test_a_stream_replaces_by_key_and_may_be_run_again(spark, tmp_path):
    path, source = f"file://{tmp_path}/t", f"{tmp_path}/in"

    def run():
        s = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(source)
        s.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(stores.replacing(path, "key")).trigger(availableNow=True).start().awaitTermination()

    first, second = [(1, 1, 0, 1), (2, 1, 40 * DAY, 1), (3, 2, 0, 1)], [(4, 1, 41 * DAY, 2)]
    schema = stores.with_month(spark.createDataFrame(first, ROWS)).schema
    for rows, want in ((first, first), (second, [first[2], *second])):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(source)
        run()
        assert listed(stores.read_months(spark, path, schema).drop("month")) == Counter(want)
    run()
    stores.replacing(path, "key")(spark.createDataFrame(second, ROWS), 1)
    assert listed(stores.read_months(spark, path, schema).drop("month")) == Counter([first[2], *second])


def test_intake_of_broken_and_repeated_files(spark, tmp_path):
    store, drop = f"file://{tmp_path}/store", tmp_path / "drop"
    drop.mkdir()
    files = {"a.bin": b"one", "b.bin": b"two", "copy.bin": b"one", "short.bin": b"thre", "wrong.bin": b"foor", "stray.bin": b"x"}
    told = {"a.bin": b"one", "b.bin": b"two", "copy.bin": b"one", "short.bin": b"three", "wrong.bin": b"four", "never.bin": b"y"}
    manifests = spark.createDataFrame([(n, hashlib.sha256(c).hexdigest().upper(), len(c)) for n, c in told.items()], "name string, sha256 string, bytes long")

    def run():
        s = stores.arriving_files(spark, f"file://{drop}", 2)
        s.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda batch, n: stores.take_in(batch, manifests, store)).trigger(availableNow=True).start().awaitTermination()

    for name in ("a.bin", "short.bin", "stray.bin"):
        (drop / name).write_bytes(files[name])
    run()
    for name in files:
        if not (drop / name).exists():
            (drop / name).write_bytes(files[name])
    run()
    run()
    stores.take_in(spark.createDataFrame([("a.bin", b"one"), ("short.bin", b"three")], "name string, content binary"), manifests, store)
    names, blobs = stores.taken_in(spark, store)
    assert {r.name: r.verdict for r in names.collect()} == {"a.bin": "ok", "b.bin": "ok", "copy.bin": "ok", "short.bin": "ok", "wrong.bin": "digest", "stray.bin": "no manifest"}
    assert sorted((r.sha256, bytes(r.content), r.bytes, r.shard) for r in blobs.collect()) == sorted((h, c, len(c), h[:2]) for c in (b"one", b"two", b"three") for h in [hashlib.sha256(c).hexdigest()])


STATES = "kind string, src string, dst string, event long, at long, until long, confidence double, metadata map<string,string>"


def edge_rows(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = draw.randrange(40)
        rows.append((draw.choice("kl"), str(draw.randrange(3)), str(draw.randrange(3)), i if draw.random() < 0.9 else None, at, at + draw.randrange(5), draw.choice([None, at / 8]), {k: draw.choice([None, str(i)]) for k in draw.sample("xyz", draw.randrange(4))}))
    return rows + [("k", "hot", "0", 10_000 + i, i, i, None, {}) for i in range(400)]


def states(spark, rows):
    df = spark.createDataFrame(rows, STATES)
    return observed(df, *(F.col(c) for c in ("kind", "src", "dst", "event", "at", "until", "confidence", "metadata")))


def folded_edges(rows):
    out = {}
    for kind, src, dst, event, at, until, confidence, metadata in rows:
        if src != dst:
            e = out.setdefault((kind, src, dst), {"n": 0, "span": [at, until], "samples": set(), "confidence": [], "metadata": {}})
            e["n"] += 1
            e["span"] = [min(e["span"][0], at), max(e["span"][1], until)]
            e["samples"].add((at, event))
            order = (at, event is not None, event or 0)
            if confidence is not None:
                e["confidence"].append((order, confidence))
            for k, v in metadata.items():
                if v is not None:
                    e["metadata"].setdefault(k, []).append((order, v))
    newest = lambda s: sorted(s, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:16]
    return {k: (e["n"], *e["span"], newest(e["samples"]), max(e["confidence"], default=(None, None))[1], {m: max(v)[1] for m, v in e["metadata"].items()}) for k, e in out.items()}


def told(df):
    return {(r.kind, r.src, r.dst): (r.n, r.first_ns, r.last_ns, [tuple(s) for s in r.evidence], r.confidence and r.confidence.value, {k: v.value for k, v in r.metadata.items()}) for r in df.collect()}


def test_a_fold_of_folds_is_the_fold(spark):
    rows = edge_rows(300, 1)
    whole = told(merged_edges(states(spark, rows)))
    assert whole == folded_edges(rows)
    parts = [merged_edges(states(spark, rows[k::3])) for k in range(3)]
    assert told(merged_edges(merged_edges(parts[2].unionByName(parts[0])).unionByName(parts[1]))) == whole
    names = spark.createDataFrame([("0", "2"), ("hot", "2")], "id string, survivor string")
    to = lambda x: "2" if x in ("0", "hot") else x
    assert told(merged_edges(renamed(merged_edges(states(spark, [r for r in rows if to(r[1]) != to(r[2])])), names))) == folded_edges([(r[0], to(r[1]), to(r[2]), *r[3:]) for r in rows])
    none = merged_edges(states(spark, rows[:1]).limit(0))
    assert none.columns == [*KEYS, "n", "first_ns", "last_ns", "evidence", "confidence", "metadata"] and not none.collect()


def test_a_drain_split_into_runs_and_begun_again(spark, tmp_path):
    rows = edge_rows(200, 2)
    source = states(spark, [r for r in rows if r[3] is not None]).withColumns({"created_ns": F.col("first_ns") * SECOND, "id": F.element_at("evidence", 1)["event"]})
    settled = folded_edges([r for r in rows if r[3] is not None and r[4] * SECOND <= 60 * SECOND - drains.SETTLE])
    for budget in (37, 1_000):
        place = f"file://{tmp_path}/{budget}"
        assert drains.table_of(spark, place) is None
        taken, n, failed = 0, 1, False
        while n:
            if taken and not failed and budget < 100:
                failed = True

                def stops(rows, table):
                    raise RuntimeError

                with pytest.raises(RuntimeError):
                    drains.drained_once(source, place, 60 * SECOND, stops, budget)
                # A run that has written its table but not its mark.
                drains.edges_folded(source, None).write.parquet(f"{place}/table/{drains.mark_of(spark, place)[0] + 1}")
            n = drains.drained_once(source, place, 60 * SECOND, drains.edges_folded, budget)
            taken += n
            assert n <= budget
        assert told(drains.table_of(spark, place)) == settled
        # Rows that had not settled come with a later run.
    while drains.drained_once(source, place, 600 * SECOND, drains.edges_folded, 1_000):
        pass
    assert told(drains.table_of(spark, place)) == folded_edges([r for r in rows if r[3] is not None])


def stream_of(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


SENTENCES = "device long, id long, speaker string, start_ns long, end_ns long"


def test_open_tails_equal_the_batch_after_any_split(spark, tmp_path):
    draw, rows = random.Random(3), []
    for device in range(4):
        at = 0
        for i in range(60):
            at += draw.choice([1, 2, 5, 20, 21, 60])
            length = draw.randrange(1, 4)
            rows.append((device, device * 100 + i, draw.choice(["a", "b", None]), at * SECOND, (at + length) * SECOND))
            at += length
    gap = 20 * SECOND
    last = max(r[3] for r in rows)
    want = Counter()
    for device in range(4):
        blocks = []
        for r in sorted((r for r in rows if r[0] == device), key=lambda r: (r[3], r[1])):
            if not blocks or r[3] - blocks[-1][-1][4] > gap:
                blocks.append([])
            blocks[-1].append(r)
        want.update((device, b[0][1], *r[1:]) for b in blocks if b[-1][4] + gap < last for r in b)
    for name, cuts in (("one", [240]), ("three", [50, 170, 240]), ("many", list(range(30, 241, 30)))):
        rows.sort(key=lambda r: r[3])
        with tails.stateful(spark):
            for a, b in zip([0, *cuts], cuts, strict=False):
                part = rows[a:b]
                draw.shuffle(part)
                spark.createDataFrame(part, SENTENCES).coalesce(1).write.mode("append").json(f"{tmp_path}/{name}/in")
                closed = tails.closed_blocks(stream_of(spark, f"{tmp_path}/{name}/in", SENTENCES), gap, "0 seconds")
                closed.writeStream.option("checkpointLocation", f"{tmp_path}/{name}/c").outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}/out").trigger(availableNow=True).start().awaitTermination()
        assert listed(spark.read.parquet(f"{tmp_path}/{name}/out").select("device", "block", "id", "speaker", "start_ns", "end_ns")) == want, name


def test_a_conversation_closes_once_by_both_clocks(spark, tmp_path):
    schema, now = "conversation string, start_ns long, end_ns long", time.time_ns()

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def seen():
        return listed(spark.read.schema(f"{schema}, n long").parquet(f"{tmp_path}/out"))

    def until(want):
        end = time.time() + 60
        while time.time() < end and seen() != want:
            time.sleep(0.5)
        return seen()

    def start():
        s = tails.closes(stream_of(spark, f"{tmp_path}/in", schema, 100), 10 * SECOND, 3 * SECOND)
        return s.writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("append").format("parquet").option("path", f"{tmp_path}/out").trigger(processingTime="500 milliseconds").start()

    # One that is old by its own clock, and one that goes on for another hour.
    put([("old", 0, 5 * SECOND), ("old", 6 * SECOND, 7 * SECOND), ("open", 0, now + 3600 * SECOND)])
    spark.createDataFrame([], f"{schema}, n long").write.parquet(f"{tmp_path}/out")
    with tails.stateful(spark):
        job = start()
        try:
            want = Counter([("old", 0, 7 * SECOND, 2)])
            assert until(want) == want
            put([("old", 8 * SECOND, 9 * SECOND), ("open", 1, 2)])
            time.sleep(1)
        finally:
            job.stop()
        job = start()  # what is open is in the state, and timers go on with the next rows
        try:
            put([("open", 2, 3)])
            want.update([("old", 8 * SECOND, 9 * SECOND, 1)])
            assert until(want) == want
        finally:
            job.stop()
