"""Text and predicate queries: normalisation, plates, similarity, audit paths, gates and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.registry import query
from tracewright.sources.driver_tables import SEGMENTS_SQL, read, segments

_FOLD = "translate({0}, 'OQDILBSZG', '000118526')"
_KEY = "upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"


@query("plate_keys", f"SELECT c_custkey, {_KEY.format('c_name')} AS plate_key, {_FOLD.format(_KEY.format('c_name'))} AS folded FROM customer")
def plate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.plate_key(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", key.alias("plate_key"), text.fold_confusables(key).alias("folded"))


@query(
    "plate_edit_matches",
    f"WITH b AS (SELECT DISTINCT {_KEY.format('p_brand')} AS plate FROM part) SELECT a.plate AS a, b.plate AS b, levenshtein(a.plate, b.plate) AS edits FROM b a JOIN b ON a.plate < b.plate WHERE levenshtein(a.plate, b.plate) <= 1",
)
def plate_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates one edit apart share what is left of one of them when a sign is dropped, so the join is on that."""
    b = read(spark, sf_dir, "part").select(text.plate_key(F.col("p_brand")).alias("plate")).distinct()
    rest = F.transform(F.sequence(F.lit(1), F.length("plate")), lambda i: F.concat(F.substring(F.col("plate"), F.lit(1), i - 1), F.substring(F.col("plate"), i + 1, F.length("plate"))))
    keyed = b.select("plate", F.explode(F.array_distinct(F.array_append(rest, F.col("plate")))).alias("rest"))
    pairs = keyed.withColumnRenamed("plate", "a").join(keyed.withColumnRenamed("plate", "b"), "rest").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("edits", F.levenshtein("a", "b").cast("long")).where("edits <= 1")


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    "trigram_matches",
    f"""WITH t AS (SELECT DISTINCT n_name, {_TRI.format('n_name')} AS g FROM nation), x AS (SELECT a.n_name AS a, b.n_name AS b, len(list_intersect(a.g, b.g)) AS s, len(a.g) AS n, len(b.g) AS m FROM t a JOIN t b ON a.n_name < b.n_name)
SELECT a, b, round(s / (n + m - s), 6) AS similarity FROM x WHERE s / (n + m - s) >= 0.3""",
)
def trigram_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share at least 0.3 of their trigrams; pairs without one in common never meet."""
    t = read(spark, sf_dir, "nation").select("n_name").distinct().withColumn("g", text.trigrams(F.col("n_name")))
    keyed = t.select("n_name", "g", F.explode("g").alias("one"))
    pairs = keyed.select(F.col("n_name").alias("a"), F.col("g").alias("x"), "one").join(keyed.select(F.col("n_name").alias("b"), F.col("g").alias("y"), "one"), "one").where("a < b").dropDuplicates(["a", "b"])
    return pairs.withColumn("similarity", text.trigram_similarity(F.col("x"), F.col("y"))).where("similarity >= 0.3").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "plate_position_vote",
    f"""WITH r AS (SELECT p_size AS plate, {_KEY.format('p_brand')} AS read, p_retailprice / 3000 AS conf FROM part), l AS (SELECT plate, length(read) AS n, sum(conf) AS w FROM r GROUP BY 1, 2),
b AS (SELECT plate, n FROM (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY round(w, 6) DESC, n) AS k FROM l) WHERE k = 1),
c AS (SELECT r.plate, unnest(range(1, n + 1)) AS i, read, conf FROM r JOIN b ON r.plate = b.plate AND length(read) = n), s AS (SELECT plate, i, substr(read, i, 1) AS ch, sum(conf) AS w FROM c GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY plate, i ORDER BY round(w, 6) DESC, ch) AS k FROM s) SELECT plate, string_agg(ch, '' ORDER BY i) AS voted FROM k WHERE k = 1 GROUP BY plate""",
)
def plate_position_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of many reads of a plate: the length of most confidence, then at each place the sign of most confidence."""
    r = read(spark, sf_dir, "part").select(F.col("p_size").alias("plate"), text.plate_key(F.col("p_brand")).alias("read"), (F.col("p_retailprice") / 3000).alias("conf")).withColumn("n", F.length("read"))
    best = lambda df, keys, tie: df.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("w", 6)), tie))).where("k = 1")
    length = best(r.groupBy("plate", "n").agg(F.sum("conf").alias("w")), ["plate"], "n").select("plate", "n")
    signs = r.join(length, ["plate", "n"]).select("plate", "conf", F.posexplode(F.split("read", "")).alias("i", "ch"))
    won = best(signs.groupBy("plate", "i", "ch").agg(F.sum("conf").alias("w")), ["plate", "i"], "ch")
    return won.groupBy("plate").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "ch")))["ch"], "").alias("voted"))


@query(
    "document_sentences",
    "WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.?!]+[.?!]*'), lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS chars FROM s",
)
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").withColumn("s", s).select("doc_id", F.size("s").cast("long").alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("paragraph_chunks")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = text.packed_paragraphs(F.col("text"), 1_200)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks).alias("seq", "chunk")).select("doc_id", "seq", F.length("chunk").alias("n"))


@query(
    "audit_paths",
    """SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) - 1 AS parts,
CASE WHEN contains(url, '?') THEN 'query' WHEN url LIKE '%/' THEN 'list' ELSE 'read' END AS action FROM pages""",
)
def audit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, depth and verb of a path by the position of its parts."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    action = F.when(F.contains("url", F.lit("?")), "query").when(F.col("url").endswith("/"), "list").otherwise("read")
    return read(spark, sf_dir, "pages").select("page_id", parts[0].alias("host"), (F.size(parts) - 1).cast("long").alias("parts"), action.alias("action"))


@query(
    "silence_gate",
    f"WITH {SEGMENTS_SQL}, x AS (SELECT session, sequence, part, bytes / 100000.0 AS rms, duration_ns / 3.6e12 AS speech FROM g) SELECT CASE WHEN rms <= 0.05 THEN 'rms' WHEN speech < 3 THEN 'vad' ELSE 'none' END AS verdict, count(*) AS n, CASE WHEN rms > 0.5 THEN 'enqueue' WHEN part % 100 < 5 THEN 'audit' ELSE 'skip' END AS gate FROM x GROUP BY ALL",
)
def silence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud enough goes on; of the rest a fixed share, drawn from the id, is audited."""
    rms, speech = F.col("bytes") / 100000.0, F.col("duration_ns") / 3.6e12
    verdict = F.when(rms <= 0.05, "rms").when(speech < 3, "vad").otherwise("none")
    gate = F.when(rms > 0.5, "enqueue").when(F.col("part") % 100 < 5, "audit").otherwise("skip")
    return segments(spark, sf_dir).groupBy(verdict.alias("verdict"), gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "voice_quality",
    f"WITH {SEGMENTS_SQL}, x AS (SELECT 20 * log10(bytes / greatest(duration_ns / 1e10, 1e-6)) AS snr, duration_ns / 3.6e12 AS speech FROM g) SELECT CASE WHEN speech < 5 OR snr < 10 THEN 'reject' WHEN speech >= 20 AND snr >= 40 THEN 'mint' ELSE 'attach' END AS quality, count(*) AS n FROM x GROUP BY 1",
)
def voice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    snr, speech = 20 * F.log10(F.col("bytes") / F.greatest(F.col("duration_ns") / 1e10, F.lit(1e-6))), F.col("duration_ns") / 3.6e12
    quality = F.when((speech < 5) | (snr < 10), "reject").when((speech >= 20) & (snr >= 40), "mint").otherwise("attach")
    return segments(spark, sf_dir).groupBy(quality.alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "intents",
    "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'when|last|latest|recent') THEN 'recency' WHEN regexp_matches(lower(text), 'who|with') THEN 'people' WHEN contains(lower(text), 'how many') THEN 'count' ELSE 'search' END AS intent FROM conversations",
)
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    intent = F.when(low.rlike("when|last|latest|recent"), "recency").when(low.rlike("who|with"), "people").when(F.contains(low, F.lit("how many")), "count").otherwise("search")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", intent.alias("intent"))


@query(
    "percent_formats",
    "SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY o_orderstatus",
)
def percent_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("o_orderstatus", "n", text.percent(F.col("n"), F.col("total")).alias("pct"))


@query(
    "config_fingerprint",
    "SELECT p_partkey, substr(sha256(concat_ws('|', p_brand, p_type, p_size)), 1, 16) AS fingerprint FROM part",
)
def config_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("|", "p_brand", "p_type", "p_size"), 256), 1, 16).alias("fingerprint"))


@query(
    "name_resolution",
    """WITH n AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT DISTINCT n_name FROM nation UNION SELECT DISTINCT p_type FROM part), q AS (SELECT 'economy brushed steel parts for the united states building' AS text)
SELECT name FROM n, q WHERE len(list_filter(string_split(trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: NOT list_contains(string_split(text, ' '), w))) = 0""",
)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names all of whose words occur in the question as whole words."""
    asked = F.split(F.lit("economy brushed steel parts for the united states building"), " ")
    names = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).union(read(spark, sf_dir, "nation").select("n_name")).union(read(spark, sf_dir, "part").select("p_type")).distinct()
    return names.where(F.size(F.array_except(F.split(text.plain(F.col("name")), " "), asked)) == 0)
