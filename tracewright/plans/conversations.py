"""Conversations: grouping of turns, talk balance, catalogues, and disentangled threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.text import plain, truncated
from tracewright.functions.timeq import SECOND
from tracewright.operators.intervals import number_runs
from tracewright.operators.threading import conversation_rows, thread_conversations
from tracewright.registry import query
from tracewright.sources.driver_tables import TURNS_SQL, read, turns

GAP = 2 * SECOND
TARGET = "assistant"
_ORDER = "PARTITION BY conv_id ORDER BY start_ns, turn"


def _by_conv():
    return W.partitionBy("conv_id").orderBy("start_ns", "turn")


def utterances(t: DataFrame) -> DataFrame:
    """Consecutive turns of a speaker at most ``GAP`` apart; unknown speakers count as one: adds ``utterance``."""
    w = _by_conv()
    new = F.coalesce(~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | (F.col("start_ns") - F.lag("end_ns").over(w) > GAP), F.lit(True)) | (F.row_number().over(w) == 1)
    return number_runs(t.withColumn("is_new", new.cast("long")), ["conv_id"], "start_ns", "turn", name="utterance")


@query(
    "utterance_merge",
    f"""WITH {TURNS_SQL}, f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w OR start_ns - lag(end_ns) OVER w > {GAP} THEN 1 ELSE 0 END AS isn FROM t WINDOW w AS ({_ORDER})),
r AS (SELECT *, sum(isn) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS utterance FROM f)
SELECT conv_id, CAST(utterance AS BIGINT) AS utterance, any_value(speaker) AS speaker, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY conv_id, utterance""",
)
def utterance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(turns(spark, sf_dir)).groupBy("conv_id", "utterance").agg(F.first("speaker").alias("speaker"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


@query(
    "turn_index",
    f"""WITH {TURNS_SQL}, k AS (SELECT *, CASE WHEN turn % 5 = 0 THEN NULL ELSE speaker END AS who FROM t),
p AS (SELECT *, last_value(who IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT conv_id, turn, CAST(sum(CASE WHEN who IS NOT NULL AND before IS NOT NULL AND who <> before THEN 1 ELSE 0 END) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_index FROM p""",
)
def turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts changes between known speakers; an unknown one inherits (every fifth turn's speaker is unknown)."""
    who = F.when(F.col("turn") % 5 != 0, F.col("speaker"))
    before = F.last("who", ignorenulls=True).over(_by_conv().rowsBetween(W.unboundedPreceding, -1))
    changed = F.coalesce((F.col("who") != F.col("before")).cast("long"), F.lit(0))
    t = turns(spark, sf_dir).withColumn("who", who).withColumn("before", before).withColumn("changed", changed)
    return number_runs(t, ["conv_id"], "start_ns", "turn", flag="changed", name="turn_index").select("conv_id", "turn", "turn_index")


@query(
    "talk_balance",
    f"""WITH {TURNS_SQL}, c AS (SELECT conv_id, sum(length(text)) FILTER (WHERE speaker = '{TARGET}') AS own, sum(length(text)) AS total FROM t GROUP BY conv_id)
SELECT round(sum(coalesce(own, 0)) / sum(total), 6) AS share, round(median(coalesce(own, 0) / total) FILTER (WHERE total > 0), 6) AS median_share, count(*) AS conversations, count(own) AS with_target FROM c""",
)
def talk_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = turns(spark, sf_dir).groupBy("conv_id").agg(F.sum(F.when(F.col("speaker") == TARGET, F.length("text"))).alias("own"), F.sum(F.length("text")).alias("total"))
    own = F.coalesce("own", F.lit(0))
    return c.agg(F.round(F.sum(own) / F.sum("total"), 6).alias("share"), F.round(F.median(F.when(F.col("total") > 0, own / F.col("total"))), 6).alias("median_share"), F.count(F.lit(1)).alias("conversations"), F.count("own").alias("with_target"))


@query(
    "longest_monologue",
    f"""WITH {TURNS_SQL}, k AS (SELECT *, CASE WHEN turn % 5 = 0 THEN NULL ELSE speaker = '{TARGET}' END AS own FROM t),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(own) OVER w IS NULL OR own IS DISTINCT FROM lag(own) OVER w THEN 1 ELSE 0 END AS isn FROM k WINDOW w AS ({_ORDER})),
r AS (SELECT *, sum(isn) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM f),
l AS (SELECT conv_id, run, sum(end_ns - start_ns) AS spoken FROM r WHERE own GROUP BY ALL)
SELECT conv_id, CAST(max(spoken) AS BIGINT) AS longest_ns, count(*) AS runs FROM l GROUP BY conv_id""",
)
def longest_monologue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row after an unknown speaker always starts a run, and unknown rows belong to no one's run."""
    w = _by_conv()
    own = F.when(F.col("turn") % 5 != 0, F.col("speaker") == TARGET)
    new = F.lag("own").over(w).isNull() | ~F.col("own").eqNullSafe(F.lag("own").over(w))
    runs = number_runs(turns(spark, sf_dir).withColumn("own", own).withColumn("is_new", new.cast("long")), ["conv_id"], "start_ns", "turn")
    spoken = runs.where("own").groupBy("conv_id", "run").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("spoken"))
    return spoken.groupBy("conv_id").agg(F.max("spoken").alias("longest_ns"), F.count(F.lit(1)).alias("runs"))


@query(
    "conversation_catalog",
    f"""WITH {TURNS_SQL} SELECT conv_id, min(start_ns) AS started_ns, max(end_ns) AS ended_ns, count(*) AS turns, array_to_string(list_sort(list_distinct(list(speaker))), ',') AS speakers
FROM t GROUP BY conv_id HAVING list_contains(list(speaker), 'user') AND list_contains(list(speaker), '{TARGET}')""",
)
def conversation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which all of the named speakers took part."""
    c = turns(spark, sf_dir).groupBy("conv_id").agg(F.min("start_ns").alias("started_ns"), F.max("end_ns").alias("ended_ns"), F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_set("speaker")).alias("s"))
    asked = F.array(F.lit("user"), F.lit(TARGET))
    return c.where(F.size(F.array_except(asked, "s")) == 0).select("conv_id", "started_ns", "ended_ns", "turns", F.array_join("s", ",").alias("speakers"))


@query(
    "latest_conversation_window",
    f"""WITH {TURNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_ns DESC, turn DESC) AS k, sum(length(trim(text))) OVER (PARTITION BY conv_id ORDER BY start_ns DESC, turn DESC ROWS UNBOUNDED PRECEDING) AS chars,
  lead(start_ns) OVER ({_ORDER}) - end_ns AS gap FROM t),
b AS (SELECT *, min(CASE WHEN k > 1 AND (gap > {GAP} OR k > 6 OR chars > 4000) THEN k END) OVER (PARTITION BY conv_id) AS stop FROM n)
SELECT conv_id, turn FROM b WHERE stop IS NULL OR k < stop""",
)
def latest_conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the newest turn back to a gap, six turns or 4,000 characters; the newest one always stays."""
    back = W.partitionBy("conv_id").orderBy(F.desc("start_ns"), F.desc("turn"))
    n = turns(spark, sf_dir).withColumns({"k": F.row_number().over(back), "chars": F.sum(F.length(F.trim("text"))).over(back.rowsBetween(W.unboundedPreceding, 0)), "gap": F.lead("start_ns").over(_by_conv()) - F.col("end_ns")})
    stops = F.when((F.col("k") > 1) & ((F.col("gap") > GAP) | (F.col("k") > 6) | (F.col("chars") > 4000)), F.col("k"))
    return n.withColumn("stop", F.min(stops).over(W.partitionBy("conv_id"))).where("stop is null or k < stop").select("conv_id", "turn")


@query(
    "digest_excerpts",
    f"""WITH {TURNS_SQL}, a AS (SELECT conv_id, turn FROM t ORDER BY start_ns DESC, conv_id DESC, turn DESC LIMIT 5), b AS (SELECT conv_id, turn FROM t WHERE speaker = 'user' AND length(text) > 8 ORDER BY length(text) DESC, conv_id, turn LIMIT 5),
c AS (SELECT conv_id, turn FROM t WHERE speaker = '{TARGET}' AND length(text) > 8 ORDER BY length(text) DESC, conv_id, turn LIMIT 5)
SELECT DISTINCT conv_id, turn FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
)
def digest_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest turns and each side's five longest, each once."""
    t = turns(spark, sf_dir)
    long_of = lambda who: t.where((F.col("speaker") == who) & (F.length("text") > 8)).orderBy(F.desc(F.length("text")), "conv_id", "turn").limit(5)
    newest = t.orderBy(F.desc("start_ns"), F.desc("conv_id"), F.desc("turn")).limit(5)
    return newest.unionByName(long_of("user")).unionByName(long_of(TARGET)).select("conv_id", "turn").dropDuplicates(["conv_id", "turn"])


@query(
    "speech_style",
    f"""WITH {TURNS_SQL} SELECT speaker, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_chars, round(avg(CASE WHEN position('?' IN text) > 0 THEN 1.0 ELSE 0.0 END), 6) AS question_share,
  CAST(sum(end_ns - start_ns) AS BIGINT) AS spoken_ns FROM t GROUP BY speaker""",
)
def speech_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("speaker").agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
        F.round(F.avg(F.when(F.instr("text", "?") > 0, 1.0).otherwise(0.0)), 6).alias("question_share"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("spoken_ns"),
    )


@query(
    "speaker_roster",
    f"WITH {TURNS_SQL} SELECT speaker, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY start_ns, conv_id, turn) AS k FROM t) WHERE k = 1",
)
def speaker_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest turn of each speaker; unknown speakers are one group."""
    k = F.row_number().over(W.partitionBy("speaker").orderBy("start_ns", "conv_id", "turn"))
    return turns(spark, sf_dir).withColumn("k", k).where("k = 1").select("speaker", "conv_id", "turn")


@query(
    "unnamed_ordinals",
    f"""WITH {TURNS_SQL}, m AS (SELECT conv_id, speaker, min(start_ns * 1000 + turn) AS moment FROM t GROUP BY ALL)
SELECT conv_id, speaker, dense_rank() OVER (PARTITION BY conv_id ORDER BY moment) AS ordinal FROM m""",
)
def unnamed_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = turns(spark, sf_dir).groupBy("conv_id", "speaker").agg(F.min(F.col("start_ns") * 1000 + F.col("turn")).alias("at"))
    return m.select("conv_id", "speaker", F.dense_rank().over(W.partitionBy("conv_id").orderBy("at")).cast("long").alias("ordinal"))


@query(
    "utterance_pairs",
    f"WITH {TURNS_SQL}, d AS (SELECT DISTINCT conv_id, speaker FROM t) SELECT a.speaker AS a, b.speaker AS b, count(*) AS observation_count FROM d a JOIN d b ON a.conv_id = b.conv_id AND a.speaker < b.speaker GROUP BY ALL",
)
def utterance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unordered pair of a conversation's speakers, once a conversation."""
    sets = turns(spark, sf_dir).groupBy("conv_id").agg(F.collect_set("speaker").alias("s"))
    return sets.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("observation_count"))


@query(
    "history_window",
    f"WITH {TURNS_SQL} SELECT conv_id, turn, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t) WHERE k <= 3",
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns(spark, sf_dir).withColumn("k", k).where("k <= 3").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query(
    "earliest_utterances",
    f"""WITH {TURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY conv_id, turn) AS k FROM t), a AS (SELECT speaker, string_agg(conv_id || '/' || turn, ',' ORDER BY k) AS first_three FROM k WHERE k <= 3 GROUP BY speaker),
n AS (SELECT unnest(['user', 'assistant', 'system', 'nobody']) AS speaker) SELECT n.speaker, coalesce(first_three, '') AS first_three FROM n LEFT JOIN a ON n.speaker = a.speaker""",
)
def earliest_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three for each name of the roster, and an empty list for who never spoke."""
    k = turns(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("speaker").orderBy("conv_id", "turn"))).where("k <= 3")
    lists = k.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws("/", "conv_id", "turn").alias("at")))).alias("l"))
    names = spark.createDataFrame([(x,) for x in ("user", "assistant", "system", "nobody")], "speaker string")
    return names.join(lists, "speaker", "left").select("speaker", F.coalesce(F.array_join("l.at", ","), F.lit("")).alias("first_three"))


@query(
    "turn_texts",
    f"""WITH {TURNS_SQL} SELECT conv_id, turn, CASE WHEN length(trim(text)) > 40 THEN rtrim(substr(trim(text), 1, 40)) || '…' ELSE trim(text) END AS short, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS plain FROM t""",
)
def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", truncated(F.col("text"), 40).alias("short"), plain(F.col("text")).alias("plain"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two conversations at a time heard by one device, in turn: ``device, id, speaker, start_ns, end_ns, embedding, prior``.

    Pairs of turns alternate, with a long silence after every sixth; some speakers are unknown, some sentences off the topic or
    without a vector, and some conversations share an id from before."""
    conv, turn = F.col("conv_id"), F.col("turn")
    start = (F.expr("turn div 2") * 24 + turn % 2 * 5 + conv % 2 * 12 + F.expr("turn div 6") * 400) * SECOND
    vec = F.when(turn % 7 == 5, None).when(turn % 5 == 3, (conv + turn + 250) % 500).otherwise(conv % 500)
    said = read(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 2").alias("device"), (conv * 1000 + turn).alias("id"), F.when((conv * 7 + turn) % 9 != 4, F.concat_ws("-", "role", "conv_id")).alias("speaker"),
        start.alias("start_ns"), (start + 4 * SECOND).alias("end_ns"), vec.alias("vec_id"), F.when(conv % 3 != 0, F.concat(F.lit("p"), F.expr("conv_id div 4"))).alias("prior"),
    )
    return said.join(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


@query("threads")
def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation and turn of every sentence; a new id is that of the device and the first sentence."""
    return thread_conversations(sentences(spark, sf_dir))


@query("thread_catalogue")
def thread_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(spark, sf_dir)
    return conversation_rows(s, thread_conversations(s))
