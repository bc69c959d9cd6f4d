"""What questions say: time windows, plates, object classes; and times and texts as people write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.timeq import DAY, HOUR, SECOND, civil_day, floor_div, nanos, weekday_monday
from tracewright.registry import query
from tracewright.sources.driver_tables import SIGHTINGS_SQL, read, sightings

#: Names of the object classes, fixed values.
LABELS = """person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, parking meter, bench, bird, cat, dog,
horse, sheep, cow, elephant, bear, zebra, giraffe, backpack, umbrella, handbag, tie, suitcase, frisbee, skis, snowboard, sports ball, kite, baseball bat,
baseball glove, skateboard, surfboard, tennis racket, bottle, wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot,
hot dog, pizza, donut, cake, chair, couch, potted plant, bed, dining table, toilet, tv, laptop, mouse, remote, keyboard, cell phone, microwave, oven, toaster,
sink, refrigerator, book, clock, vase, scissors, teddy bear, hair drier, toothbrush""".replace("\n", " ").split(", ")
#: Other words for them, fixed values.
ALIASES = {
    "person": ["people", "persons", "human", "humans", "man", "woman", "men", "women", "guy", "guys", "somebody", "someone"],
    "bus": ["buses"],
    "knife": ["knives"],
    "wine glass": ["wine glasses", "wineglass", "wineglasses"],
    "tv": ["television", "televisions", "tvs", "tv set"],
    "cell phone": ["phone", "phones", "cellphone", "cellphones", "cell phones", "mobile phone", "smartphone", "smartphones"],
    "couch": ["sofa", "sofas", "couches"],
    "laptop": ["laptops"],
    "potted plant": ["plants", "potted plants"],
}


def question_window(text: Column, now_ns: Column, offset_s: Column) -> Column:
    """The window ``after, before`` (nanoseconds) that a question names on the asker's clock; null if it names none.

    The last or past number of minutes, hours or days (one if no number is said) goes first; then parts of today, the night
    before, days, and weeks from Monday, the first of these phrases that the text holds."""
    said, offset_s = F.lower(text), offset_s.cast("long")
    words = F.filter(F.transform(F.split(said, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    form = r" (?:last|past) (?:0*([1-9][0-9]{0,4}|100000) )?(minutes?|mins?|hours?|hrs?|days?) "
    unit = F.substring(F.regexp_extract(line, form, 2), 1, 1)
    n = F.coalesce(F.nullif(F.regexp_extract(line, form, 1), F.lit("")), F.lit("1")).cast("long")
    span = n * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(86_400) * SECOND
    today = civil_day(now_ns, offset_s)
    at = lambda day, hour: day * DAY + hour * HOUR - offset_s * SECOND
    window = lambda a, b: F.struct(a.alias("after"), b.alias("before"))
    monday = today - weekday_monday(now_ns, offset_s)
    has = lambda *phrases: F.greatest(*(F.contains(said, F.lit(p)) for p in (*phrases, phrases[0])))
    return (
        F.when(unit != "", window(now_ns - span, now_ns)).when(has("this morning"), window(at(today, 0), at(today, 12))).when(has("this afternoon"), window(at(today, 12), at(today, 18)))
        .when(has("this evening", "tonight"), window(at(today, 18), at(today, 24))).when(has("last night"), window(at(today, -4), at(today, 4))).when(has("yesterday"), window(at(today, -24), at(today, 0)))
        .when(has("today"), window(at(today, 0), at(today, 24))).when(has("last week"), window(at(monday - 7, 0), at(monday, 0))).when(has("this week"), window(at(monday, 0), at(monday + 7, 0)))
    )


#: What the table's turns are made to ask, one after the other.
_ASKED = [
    "who came in the last 3 hours", "past 20 mins?", "what happened last night", "anything from yesterday?", "the plan this morning today", "last week's meeting", "this week", "anything", "in the last hour, please",
    "when was the last time", "last 0 minutes", "tonight", "this afternoon", "deliveries in the past 2 days today", "today",
]
_ASKED_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _ASKED) + "]"
_QUESTIONS_SQL = f"""q AS (SELECT conv_id, turn, text || ' ' || {_ASKED_SQL}[(conv_id * 7 + turn) % {len(_ASKED)} + 1] AS said, 1710430200 + conv_id * 9000 + turn * 400 AS now, (conv_id % 5 - 2) * 3600 AS off FROM conversations),
p AS (SELECT *, lower(said) AS l, (now + off) // 86400 AS d, regexp_extract(' ' || array_to_string(list_filter([regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') FOR w IN regexp_split_to_array(lower(said), '\\s+')], lambda w: w <> ''), ' ') || ' ',
  ' (?:last|past) (?:0*([1-9][0-9]{{0,4}}|100000) )?(minutes?|mins?|hours?|hrs?|days?) ', ['n', 'unit']) AS r FROM q),
w AS (SELECT conv_id, turn, now, CASE WHEN r.unit <> '' THEN [now - CAST(CASE r.n WHEN '' THEN '1' ELSE r.n END AS BIGINT) * CASE r.unit[1] WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END, now]
  WHEN contains(l, 'this morning') THEN [d * 86400 - off, d * 86400 + 43200 - off] WHEN contains(l, 'this afternoon') THEN [d * 86400 + 43200 - off, d * 86400 + 64800 - off]
  WHEN contains(l, 'this evening') OR contains(l, 'tonight') THEN [d * 86400 + 64800 - off, d * 86400 + 86400 - off] WHEN contains(l, 'last night') THEN [d * 86400 - 14400 - off, d * 86400 + 14400 - off]
  WHEN contains(l, 'yesterday') THEN [d * 86400 - 86400 - off, d * 86400 - off] WHEN contains(l, 'today') THEN [d * 86400 - off, d * 86400 + 86400 - off]
  WHEN contains(l, 'last week') THEN [(d - (d + 3) % 7 - 7) * 86400 - off, (d - (d + 3) % 7) * 86400 - off] WHEN contains(l, 'this week') THEN [(d - (d + 3) % 7) * 86400 - off, (d - (d + 3) % 7 + 7) * 86400 - off] END AS x FROM p)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, window``: what each turn says, with a phrase about time, asked at some time on some clock."""
    conv, turn = F.col("conv_id"), F.col("turn")
    phrase = F.element_at(F.array(*(F.lit(x) for x in _ASKED)), ((conv * 7 + turn) % len(_ASKED) + 1).cast("int"))
    now = (F.lit(1_710_430_200) + conv * 9_000 + turn * 400) * SECOND
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", question_window(F.concat("text", F.lit(" "), phrase), now, (conv % 5 - 2) * 3600).alias("window"))


@query("time_windows", f"WITH {_QUESTIONS_SQL} SELECT conv_id, turn, CAST(x[1] AS BIGINT) * {SECOND} AS after_ns, CAST(x[2] AS BIGINT) * {SECOND} AS before_ns FROM w")
def time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", F.col("window.after").alias("after_ns"), F.col("window.before").alias("before_ns"))


@query(
    "questions_counted",
    f"""WITH {_QUESTIONS_SQL}, h AS (SELECT CAST(x[1] AS BIGINT) // 3600 AS a, CAST(x[2] AS BIGINT) // 3600 AS b, conv_id, turn FROM w WHERE x IS NOT NULL), s AS (SELECT (epoch_us(ts) // 3600000000) + 1680 AS hour, count(*) AS n FROM events GROUP BY 1)
SELECT conv_id, turn, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM h LEFT JOIN s ON s.hour >= h.a AND s.hour < h.b GROUP BY conv_id, turn""",
)
def questions_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sightings (moved by ten weeks) lie in the whole hours of each question's window: two look-ups in running counts."""
    asked = _questions(spark, sf_dir).where("window is not null").select("conv_id", "turn", floor_div(F.col("window.after"), HOUR).alias("a"), floor_div(F.col("window.before"), HOUR).alias("b"))
    hours = sightings(spark, sf_dir).groupBy((floor_div(F.col("start_ns"), HOUR) + 1_680).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    # The hours that windows touch are few; each window reads its own by equal keys.
    each = asked.withColumn("hour", F.explode(F.when(F.col("b") > F.col("a"), F.sequence("a", F.col("b") - 1)).otherwise(F.array("a")))).withColumn("inside", F.col("b") > F.col("a"))
    found = each.join(hours, "hour", "left")
    return found.groupBy("conv_id", "turn").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("n"))


def humanized_time(at_ns: Column, now_ns: Column, offset_s: int) -> Column:
    """A time as said at ``now`` on a clock ``offset_s`` ahead of UTC, by calendar days; a later day is "just now"."""
    local = lambda ns: F.timestamp_seconds(floor_div(ns, SECOND) + offset_s)
    days, day = civil_day(now_ns, offset_s) - civil_day(at_ns, offset_s), F.dayofmonth(local(at_ns))
    clock = F.concat(F.lit(" at "), F.date_format(local(at_ns), "h:mm a"))
    spelled = F.element_at(F.array(*(F.lit(x) for x in ("two", "three", "four", "five", "six"))), (days - 1).cast("int"))
    ending = F.when((day % 100).between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    date = F.concat(F.lit("on "), F.date_format(local(at_ns), "MMMM "), day.cast("string"), ending, F.when(F.year(local(at_ns)) != F.year(local(now_ns)), F.date_format(local(at_ns), ", yyyy")).otherwise(""))
    said = F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(spelled, F.lit(" days ago"))).when(days < 14, F.concat(F.lit("last "), F.date_format(local(at_ns), "EEEE"))).otherwise(date)
    return F.when(days < 0, "just now").otherwise(F.concat(said, clock))


def humanized_duration(ns: Column) -> Column:
    """Seconds below a minute, else whole minutes (half ones up), in hours and minutes from an hour."""
    seconds = floor_div(F.greatest(ns, F.lit(0)), SECOND)
    minutes = floor_div(seconds + 30, 60)
    counted = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    hours, rest = floor_div(minutes, 60), F.pmod(minutes, F.lit(60).cast("long"))
    long = F.concat(counted(hours, "hour"), F.when(rest > 0, F.concat(F.lit(" "), counted(rest, "minute"))).otherwise(""))
    return F.when(seconds < 60, counted(seconds, "second")).when(minutes < 60, counted(minutes, "minute")).otherwise(long)


@query(
    "humanized_times",
    """WITH m AS (SELECT max(ts) - INTERVAL 12 HOUR - INTERVAL 5 HOUR AS now FROM events), e AS (SELECT event_id, ts - INTERVAL 5 HOUR AS told, now, date_diff('day', CAST(ts - INTERVAL 5 HOUR AS DATE), CAST(now AS DATE)) AS d, CAST(trunc(value * value / 10) AS BIGINT) AS s FROM events, m),
f AS (SELECT *, (s + 30) // 60 AS mi, day(told) AS dm FROM e)
SELECT event_id, CASE WHEN d < 0 THEN 'just now' ELSE CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN ['two', 'three', 'four', 'five', 'six'][d - 1] || ' days ago' WHEN d < 14 THEN 'last ' || dayname(told)
  ELSE 'on ' || monthname(told) || ' ' || dm || CASE WHEN dm BETWEEN 11 AND 13 THEN 'th' WHEN dm % 10 = 1 THEN 'st' WHEN dm % 10 = 2 THEN 'nd' WHEN dm % 10 = 3 THEN 'rd' ELSE 'th' END || CASE WHEN year(told) <> year(now) THEN ', ' || year(told) ELSE '' END END || ' at ' || strftime(told, '%-I:%M %p') END AS said,
CASE WHEN s < 60 THEN s || CASE WHEN s = 1 THEN ' second' ELSE ' seconds' END WHEN mi < 60 THEN mi || CASE WHEN mi = 1 THEN ' minute' ELSE ' minutes' END ELSE (mi // 60) || CASE WHEN mi // 60 = 1 THEN ' hour' ELSE ' hours' END || CASE WHEN mi % 60 = 0 THEN '' WHEN mi % 60 = 1 THEN ' 1 minute' ELSE ' ' || (mi % 60) || ' minutes' END END AS lasted FROM f""",
)
def humanized_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as said twelve hours before the last one, five hours west of UTC, and how long it took."""
    e = read(spark, sf_dir, "events").select("event_id", nanos(F.col("ts")).alias("at"), (F.col("value") * F.col("value") / 10).cast("long").alias("s"))
    e = e.join(F.broadcast(e.agg((F.max("at") - 12 * HOUR).alias("now"))), F.lit(True))  # one row
    return e.select("event_id", humanized_time(F.col("at"), F.col("now"), -5 * 3600).alias("said"), humanized_duration(F.col("s") * SECOND).alias("lasted"))


@query("plate_tokens", "SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(upper(text), '[A-Z0-9]+'), lambda w: length(w) >= 4 AND regexp_matches(w, '[0-9]')))) AS tokens FROM documents WHERE text IS NOT NULL")
def plate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different runs of at least four letters and digits with a digit, which may be plates, a text holds."""
    found = F.filter(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & w.rlike("[0-9]"))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(found)).cast("long").alias("tokens"))


#: The class that each phrase names: itself, by another word, or by its plural. The words that begin a phrase of several.
NAMED = {label: label for label in LABELS} | {w: label for label, words in ALIASES.items() for w in words if w not in LABELS}
NAMED = {label + end: label for end in ("s", "es") for label in LABELS} | NAMED
ARTICLES, BEGIN = ("a", "an", "the"), sorted({phrase.split(" ")[0] for phrase in NAMED if " " in phrase})


def _classes() -> Column:
    return F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))


def object_label(phrase: Column) -> Column:
    """The class that a phrase names; null if none. One article is left out."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.lower(phrase)), r"[?.!,]+$", "")), "^(a|an|the) ", ""))
    return _classes()[bare]


def object_in_question(text: Column) -> Column:
    """The first class that two words in turn name, else the first that one word names; null if none. One article is left out.

    The words are bound by a lambda: as an expression the text would be parted again for each of its words. Phrases are told
    by a set of all names, and only the first that names a class is looked up."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    first = lambda phrases: F.get(F.filter(phrases, lambda p: p.isin(*NAMED)), 0)

    def pairs(ws: Column) -> Column:
        following = lambda i: F.get(ws, i + 1)
        return F.transform(ws, lambda w, i: F.when(w.isin(*ARTICLES), following(i)).when(w.isin(*BEGIN), F.concat(w, F.lit(" "), following(i))))

    return F.get(F.transform(F.array(words), lambda ws: _classes()[F.coalesce(first(pairs(ws)), first(ws))]), 0)


_OBJECTS = ["the cars", "a bus?", "buses", "People", "benches", "a wine glass or a cup", "an apple.", "no spaceship", "Scissors", "smartphones", "a dog at the stop sign", "teddy bears", "the skis"]
_LABEL_ROWS = ", ".join(f"('{p}', '{label}', {k})" for label in LABELS for p, k in [(label, 0), *((w, 1) for w in ALIASES.get(label, []))])


@query(
    "object_classes",
    f"""WITH k AS (SELECT * FROM (VALUES {_LABEL_ROWS}) AS x(phrase, label, alias)), q AS (SELECT conv_id, turn, [w FOR w IN regexp_split_to_array(lower(text || ' did you see ' || {_OBJECTS!r}[(conv_id * 5 + turn) % {len(_OBJECTS)} + 1]), '[^\\p{{L}}\\p{{N}}]+') IF w <> ''] AS w FROM conversations),
c AS (SELECT conv_id, turn, 0 AS kind, unnest(range(1, len(w))) AS i, w FROM q UNION ALL SELECT conv_id, turn, 1, unnest(range(1, len(w) + 1)), w FROM q),
b AS (SELECT conv_id, turn, kind, i, trim(regexp_replace(CASE kind WHEN 0 THEN w[i] || ' ' || w[i + 1] ELSE w[i] END, '^(a|an|the) ', '')) AS p FROM c),
l AS (SELECT b.*, coalesce(k.label, CASE WHEN p LIKE '%es' THEN e.label END, CASE WHEN p LIKE '%s' THEN s.label END) AS label FROM b LEFT JOIN k ON k.phrase = p LEFT JOIN k e ON e.alias = 0 AND e.phrase || 'es' = p LEFT JOIN k s ON s.alias = 0 AND s.phrase || 's' = p),
f AS (SELECT conv_id, turn, arg_min(label, (kind, i)) AS class FROM l WHERE label IS NOT NULL GROUP BY conv_id, turn)
SELECT q.conv_id, q.turn, f.class FROM q LEFT JOIN f ON f.conv_id = q.conv_id AND f.turn = q.turn""",
)
def object_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn, with a question about things seen, asks for."""
    phrase = F.element_at(F.array(*(F.lit(x) for x in _OBJECTS)), ((F.col("conv_id") * 5 + F.col("turn")) % len(_OBJECTS) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", object_in_question(F.concat("text", F.lit(" did you see "), phrase)).alias("class"))


@query(
    "cleaned_chapters",
    r"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(^|\n)[ \t]*[0-9]{1,4}[ \t]*(\n|$)', chr(10), 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '([A-Za-z])-\n([a-z])', '\1\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '([^\n.!?])\n([^\n])', '\1 \2', 'g') AS t FROM b) SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), ' ' || chr(10))) AS cleaned FROM c""",
)
def cleaned_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without page numbers, with words and lines joined that a line's end had cut, and single spaces."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"(^|\n)[ \t]*[0-9]{1,4}[ \t]*(\n|$)", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"([A-Za-z])-\n([a-z])", "$1$2"), r"([^\n.!?])\n([^\n])", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{2,}", "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.btrim(t, F.lit(" \n")).cast("binary")).alias("cleaned"))


@query("rounded_scores", f"WITH {SIGHTINGS_SQL} SELECT event_id, round(value / 7, 4) AS score FROM s")
def rounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).select("event_id", F.round(F.col("value") / 7, 4).alias("score"))
