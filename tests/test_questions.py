"""What questions and times say, by the literal cases."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions.timeq import SECOND
from tracewright.plans.questions import humanized_duration, humanized_time, object_in_question, object_label, question_window


def ns(text):
    from datetime import UTC, datetime

    return int(datetime.strptime(text, "%Y-%m-%d %H:%M").replace(tzinfo=UTC).timestamp()) * SECOND


NOW = "2026-07-03 14:00"  # a Friday
WINDOWS = [
    ("what did we discuss", 0, None), ("who was speaking", 0, None), ("when was the last time i saw bob", 0, None), ("last 0 minutes", 0, None), ("the last 100001 hours", 0, None), ("", 0, None),
    ("what did we talk about today", 0, ("2026-07-03 00:00", "2026-07-04 00:00")), ("anything from yesterday?", 0, ("2026-07-02 00:00", "2026-07-03 00:00")),
    ("this morning", 0, ("2026-07-03 00:00", "2026-07-03 12:00")), ("this afternoon", 0, ("2026-07-03 12:00", "2026-07-03 18:00")), ("Tonight", 0, ("2026-07-03 18:00", "2026-07-04 00:00")), ("this evening", 0, ("2026-07-03 18:00", "2026-07-04 00:00")),
    ("what happened last night", 0, ("2026-07-02 20:00", "2026-07-03 04:00")), ("this week", 0, ("2026-06-29 00:00", "2026-07-06 00:00")), ("last week's meeting", 0, ("2026-06-22 00:00", "2026-06-29 00:00")),
    ("did we discuss the plan this morning today?", 0, ("2026-07-03 00:00", "2026-07-03 12:00")), ("how many people in the last 10 minutes?", 0, ("2026-07-03 13:50", NOW)), ("past 2 hours", 0, ("2026-07-03 12:00", NOW)),
    ("anything in the last 10 min?", 0, ("2026-07-03 13:50", NOW)), ("what happened in the last hour", 0, ("2026-07-03 13:00", NOW)), ("deliveries in the last 3 days", 0, ("2026-06-30 14:00", NOW)),
    ("who came by today in the last 10 minutes", 0, ("2026-07-03 13:50", NOW)), ("last last hrs", 0, ("2026-07-03 13:00", NOW)), ("today", -5 * 3600, ("2026-07-03 05:00", "2026-07-04 05:00")),
]


def test_windows(spark):
    df = spark.createDataFrame([(q, off, ns(NOW)) for q, off, _ in WINDOWS], "q string, off int, now long")
    got = [r.w and (r.w.after, r.w.before) for r in df.select(question_window(F.col("q"), F.col("now"), F.col("off")).alias("w")).collect()]
    assert got == [w and (ns(w[0]), ns(w[1])) for _, _, w in WINDOWS]


TIMES = [
    ("2026-06-26 09:07", 0, "today at 9:07 AM"), ("2026-06-25 17:14", 0, "yesterday at 5:14 PM"), ("2026-06-23 14:00", 0, "three days ago at 2:00 PM"), ("2026-06-18 10:30", 0, "last Thursday at 10:30 AM"), ("2026-03-04 17:00", 0, "on March 4th at 5:00 PM"),
    ("2025-12-31 23:50", 0, "on December 31st, 2025 at 11:50 PM"), ("2026-06-26 12:00", 0, "today at 12:00 PM"), ("2026-06-26 00:00", 0, "today at 12:00 AM"), ("2026-06-28 12:00", 0, "just now"), ("2026-06-26 17:00", 0, "today at 5:00 PM"),
    ("2026-06-26 02:00", 0, "today at 2:00 AM"), ("2026-06-26 02:00", -5 * 3600, "yesterday at 9:00 PM"), ("2026-06-12 08:00", 0, "on June 12th at 8:00 AM"), ("2026-06-13 08:00", 0, "last Saturday at 8:00 AM"), ("2026-06-20 08:00", 0, "six days ago at 8:00 AM"),
]


@pytest.mark.parametrize("offset", [0, -5 * 3600])
def test_times(spark, offset):
    cases = [c for c in TIMES if c[1] == offset]
    df = spark.createDataFrame([(ns(t), ns("2026-06-26 17:00")) for t, _, _ in cases], "at long, now long")
    assert [r.said for r in df.select(humanized_time(F.col("at"), F.col("now"), offset).alias("said")).collect()] == [c[2] for c in cases]


def test_ordinals(spark):
    days = {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 22: "22nd", 23: "23rd", 31: "31st"}
    df = spark.createDataFrame([(ns(f"2026-03-{d:02} 00:00"), ns("2026-06-26 17:00")) for d in days], "at long, now long")
    assert [r.said for r in df.select(humanized_time(F.col("at"), F.col("now"), 0).alias("said")).collect()] == [f"on March {d} at 12:00 AM" for d in days.values()]


def test_durations(spark):
    cases = {15: "15 seconds", 1: "1 second", 60: "1 minute", 42 * 60: "42 minutes", 42 * 60 + 29: "42 minutes", 42 * 60 + 31: "43 minutes", 7_800: "2 hours 10 minutes", 3_600: "1 hour", -5: "0 seconds", 59 * 60 + 30: "1 hour", 3_661: "1 hour 1 minute"}
    df = spark.createDataFrame([(s * SECOND,) for s in cases], "ns long")
    assert [r.said for r in df.select(humanized_duration(F.col("ns")).alias("said")).collect()] == list(cases.values())


def test_labels(spark):
    phrases = {"cars": "car", "the dogs?": "dog", "people": "person", "buses": "bus", "scissors": "scissors", "skis": "skis", "A Bus!": "bus", "wine glasses": "wine glass", "benches": "bench", "an apple": "apple", "spaceship": None, "": None, "s": None, "the  car": "car", "sandwiches": "sandwich"}
    df = spark.createDataFrame([(p,) for p in phrases], "p string")
    assert [r.c for r in df.select(object_label(F.col("p")).alias("c")).collect()] == list(phrases.values())
    asked = {"how many times did I see a car?": "car", "was the wine glass by the cup": "wine glass", "any cell-phones and dogs": "cell phone", "who ran the stop sign in a truck": "stop sign", "nothing here": None, "cat": "cat", "": None}
    df = spark.createDataFrame([(p,) for p in asked], "p string")
    assert [r.c for r in df.select(object_in_question(F.col("p")).alias("c")).collect()] == list(asked.values())


def test_a_question_is_parted_once(spark):
    """Not again for each of its words, and long ones are told all the same."""
    words = [f"w{k}" for k in range(3_000)]
    asked = {" ".join([*words, "the", "wine", "glasses", "or", "a", "bus"]): "wine glass", " ".join([*words, "traffic", "bus", "a"]): "bus", " ".join(words): None}
    df = spark.createDataFrame([(p,) for p in asked], "p string").select(object_in_question(F.col("p")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.c for r in df.collect()] == list(asked.values())
