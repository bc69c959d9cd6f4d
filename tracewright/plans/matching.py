"""Match-or-mint of new vectors and plates against a catalogue, and the merging of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.text import trigrams
from tracewright.operators.graphs import components, named_clusters
from tracewright.operators.minting import match_or_mint
from tracewright.operators.scratch import written
from tracewright.operators.settling import SETTLED_AT_ONCE, settled_in_order
from tracewright.operators.similar import similar_sets
from tracewright.operators.vectors import centroids, doubles, knn, normalized
from tracewright.plans.identities import _CENTROIDS, _KNN, FAR, LINKS, identity_edges
from tracewright.plans.identities import _neighbours as nearest_segments
from tracewright.registry import query
from tracewright.sources.driver_tables import VECTORS_SQL, read, vectors

#: Up to MATCH a vector is its identity's, up to ATTACH it is only attached.
MATCH, ATTACH = 0.5, 0.72


def assigned(new: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``vec_id, identity, decision`` of ``new(vec_id, embedding, clean)`` against a frozen ``catalogue(identity, centroid)``.

    The nearest centroid decides, found by blocks of products; what is near none is minted if it is clean."""
    asked = new.select(F.col("vec_id").alias("a"), normalized(doubles(F.col("embedding"))).alias("x"))
    near = knn(asked, catalogue.select(F.col("identity").cast("long").alias("b"), F.col("centroid").alias("y")), 1, same=False)
    best = new.select("vec_id", "clean").join(near.select(F.col("a").alias("vec_id"), F.col("b").alias("nearest"), F.col("distance").alias("d")), "vec_id", "left")
    decision = F.when(F.col("d") <= MATCH, "match").when(F.col("d") <= ATTACH, "attach").when(F.col("clean"), "mint").otherwise("none")
    return best.select("vec_id", decision.alias("decision"), F.when(F.col("d") <= ATTACH, F.col("nearest")).when(F.col("clean"), -F.col("vec_id")).alias("identity"))


@query(
    "voice_assignments",
    f"""WITH {_CENTROIDS}, d AS (SELECT v.vec_id, c.identity, 1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), c.mean) / (c.len * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))) AS x FROM v, cn c WHERE v.identity IS NULL),
b AS (SELECT vec_id, min(x) AS x, arg_min(identity, (x, identity)) AS identity, vec_id % 2 = 0 AS clean FROM d GROUP BY vec_id)
SELECT vec_id, CASE WHEN x <= {MATCH} THEN 'match' WHEN x <= {ATTACH} THEN 'attach' WHEN clean THEN 'mint' ELSE 'none' END AS decision, CASE WHEN x <= {ATTACH} THEN CAST(identity AS BIGINT) WHEN clean THEN -vec_id END AS identity FROM b""",
)
def voice_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unattributed vectors against the identities' centroids; those of even number are clean."""
    v = vectors(spark, sf_dir)
    catalogue = centroids(v.where("identity is not null"), "identity", "embedding").select("identity", "centroid")
    return assigned(v.where("identity is null").select("vec_id", "embedding", (F.col("vec_id") % 2 == 0).alias("clean")), catalogue)


def voices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unattributed vectors in an order of their own, those of even number clean, and the attributed ones."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("identity").cast("long").alias("identity"), F.col("embedding").alias("vec"))
    new = v.where("identity is null").select("id", ((F.col("id") * 7_919) % 100_003).alias("place"), "vec", (F.col("id") % 2 == 0).alias("clean"), F.lit(True).alias("may_mint"))
    return new, v.where("identity is not null")


def faces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All but the vectors of every third number, against these; every fifth is a restored image, which may not mint."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("identity").cast("long").alias("identity"), F.col("embedding").alias("vec"))
    new = v.where("id % 3 <> 0").select("id", ((F.col("id") * 7_919) % 100_003).alias("place"), "vec", (F.col("id") % 4 != 0).alias("clean"), (F.col("id") % 5 != 0).alias("may_mint"))
    return new, v.where("id % 3 = 0 and identity is not null")


@query("voice_mints")
def voice_mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices one after the other: a vote of near ones, else the nearest identity, known or founded before."""
    return match_or_mint(*voices(spark, sf_dir))


@query("face_assignments")
def face_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_or_mint(*faces(spark, sf_dir))


def _variants(key: str):
    """A plate and what is left of it without one of its signs: plates within one edit share one of these."""
    k = F.col(key)
    less = F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    return F.explode(F.array_distinct(F.concat(F.array(k), less)))


#: Plates are alike from this share of their trigrams and up to this many edits; of the alike ones the PLATES nearest are looked at.
ALIKE, EDITS, PLATES, LEAST_SIGNS = 0.7, 1, 5, 4


def _mints(own: dict, links: list[dict]) -> tuple[bool]:
    """Whether a plate's first clean read mints it: none of the most similar known plates is within the edits."""
    known = sorted((x for x in links if x["before"] is None or x["minted"]), key=lambda x: (-x["similarity"], x["other"]))
    return (not any(x["edits"] <= EDITS for x in known[:PLATES]),)


def plates_matched(reads: DataFrame, catalogue: DataFrame, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """``read_id, plate_id, decision`` of ``reads(read_id, place, plate, clean)`` taken in the order of ``place``.

    A read is of the plate of ``catalogue(plate_id, plate)``, or minted before it, that is equal, else of the most similar
    ones' first that is within one edit; else a clean read mints a plate (with its negative id) and another has none. Reads of
    less than four signs have none. What an order of reads decides is decided for each different text at its first clean read,
    and depends on the similar texts before it only; all reads then look up what was known at their place."""
    reads = written(reads.withColumn("plate", F.when(F.length("plate") >= LEAST_SIGNS, F.col("plate"))))
    at = F.min(F.struct("place", "read_id"))
    new = reads.where("clean and plate is not null").join(catalogue, "plate", "left_anti").groupBy("plate").agg(at.alias("at")).select("plate", "at.*")
    texts = reads.select("plate").where("plate is not null").unionByName(catalogue.select("plate")).distinct().withColumn("items", trigrams(F.col("plate")))
    pairs = similar_sets(written(texts.withColumnRenamed("plate", "id")), ALIKE)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    near = written(both.withColumnsRenamed({"a": "plate", "b": "other"}).withColumn("edits", F.levenshtein("plate", "other").cast("long")))
    seen = catalogue.select(F.col("plate").alias("other"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("long").alias("since"))
    seen = seen.unionByName(new.select(F.col("plate").alias("other"), F.col("plate").alias("before"), F.col("place").alias("since")))
    links = near.join(seen, "other").join(new.select("plate", "place"), "plate").where("since is null or since < place").select(F.col("plate").alias("item"), "before", "other", "similarity", "edits")
    minted = settled_in_order(new.select(F.col("plate").alias("item"), "place"), links, _mints, "minted boolean", at_once).where("minted")
    known = catalogue.select(F.col("plate").alias("other"), F.lit(None).cast("long").alias("since"), "plate_id")
    known = written(known.unionByName(new.join(minted, F.col("plate") == F.col("item")).select(F.col("plate").alias("other"), F.col("place").alias("since"), (-F.col("read_id")).alias("plate_id"))))
    by_text = known.select(F.col("other").alias("plate"), F.col("since").alias("own_since"), F.col("plate_id").alias("own_id"))
    own = reads.join(by_text, "plate", "left").withColumn("own", F.when(F.col("own_since").isNull() | (F.col("own_since") <= F.col("place")), F.col("own_id")))
    open_reads = own.where("own is null").select("read_id", "place", "plate")
    choice = open_reads.join(near, "plate").join(known, "other").where("since is null or since < place")
    best = choice.withColumn("k", F.row_number().over(W.partitionBy("read_id").orderBy(F.desc("similarity"), "other"))).where((F.col("k") <= PLATES) & (F.col("edits") <= EDITS))
    fuzzy = best.groupBy("read_id").agg(F.min_by("plate_id", "k").alias("fuzzy"))
    decision = F.when((F.col("own_since") == F.col("place")) & (F.col("own") == -F.col("read_id")), "mint").when(F.col("own").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "edit").otherwise("none")
    return own.join(fuzzy, "read_id", "left").select("read_id", F.coalesce("own", "fuzzy").alias("plate_id"), decision.alias("decision"))


def _plate_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three reads of each plate, two of them with a sign too many or another at the end, and a catalogue of some plates."""
    c, group = F.col("c_custkey"), F.expr("c_custkey div 3")
    plate = F.upper(F.substring(F.md5(group.cast("string").cast("binary")), 1, 12))
    read_as = F.when(c % 3 == 1, F.concat(F.substring(plate, 1, 11), F.lit("X"))).when(c % 3 == 2, F.concat(plate, F.lit("7"))).otherwise(plate)
    place = (c * 7_919) % 1_000_003
    rows = read(spark, sf_dir, "customer").select(c.alias("read_id"), place.alias("place"), F.when(c % 50 == 49, F.lit("A1")).otherwise(read_as).alias("plate"), (c % 4 != 0).alias("clean"), F.col("c_acctbal").alias("confidence"))
    known = read(spark, sf_dir, "customer").where("c_custkey % 15 = 0").select(group.alias("plate_id"), plate.alias("plate"))
    return rows, known


_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"
_PLATES_SQL = f"""r AS (SELECT c_custkey AS read_id, c_custkey * 7919 % 1000003 AS place, CASE WHEN c_custkey % 50 = 49 THEN 'A1' WHEN c_custkey % 3 = 1 THEN upper(substr(md5(CAST(c_custkey // 3 AS VARCHAR)), 1, 11)) || 'X'
  WHEN c_custkey % 3 = 2 THEN upper(substr(md5(CAST(c_custkey // 3 AS VARCHAR)), 1, 12)) || '7' ELSE upper(substr(md5(CAST(c_custkey // 3 AS VARCHAR)), 1, 12)) END AS plate, c_custkey % 4 <> 0 AS clean, c_acctbal AS confidence FROM customer),
n AS (SELECT *, row_number() OVER (ORDER BY place) AS k, {_GRAMS.format('plate')} AS g FROM r),
ca AS (SELECT upper(substr(md5(CAST(c_custkey // 3 AS VARCHAR)), 1, 12)) AS plate, c_custkey // 3 AS id FROM customer WHERE c_custkey % 15 = 0),
w AS (SELECT 0::BIGINT AS k, (SELECT list({{'plate': plate, 'id': id, 'g': {_GRAMS.format('plate')}}}) FROM ca) AS known, NULL::BIGINT AS read_id, NULL::BIGINT AS plate_id, NULL::VARCHAR AS decision
  UNION ALL SELECT k, CASE WHEN mint THEN list_append(known, {{'plate': plate, 'id': -read_id, 'g': g}}) ELSE known END, read_id, coalesce(same, near, CASE WHEN mint THEN -read_id END),
    CASE WHEN same IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'edit' WHEN mint THEN 'mint' ELSE 'none' END
  FROM (SELECT *, same IS NULL AND near IS NULL AND clean AND length(plate) >= {LEAST_SIGNS} AS mint FROM (SELECT n.*, w.known, CASE WHEN length(n.plate) >= {LEAST_SIGNS} THEN list_filter(w.known, lambda x: x.plate = n.plate)[1].id END AS same,
    CASE WHEN length(n.plate) >= {LEAST_SIGNS} THEN list_filter(list_sort(list_transform(list_filter(w.known, lambda x: len(list_intersect(x.g, n.g)) / (len(x.g) + len(n.g) - len(list_intersect(x.g, n.g))) >= {ALIKE}),
      lambda x: {{'s': -len(list_intersect(x.g, n.g)) / (len(x.g) + len(n.g) - len(list_intersect(x.g, n.g))), 'plate': x.plate, 'id': x.id}}))[1:{PLATES}], lambda x: levenshtein(x.plate, n.plate) <= {EDITS})[1].id END AS near
    FROM w JOIN n ON n.k = w.k + 1)))"""


@query("plate_assignments", f"WITH RECURSIVE {_PLATES_SQL} SELECT read_id, plate_id, decision FROM w WHERE k > 0")
def plate_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plates_matched(*_plate_reads(spark, sf_dir))


@query(
    "canonical_plates",
    f"""WITH RECURSIVE {_PLATES_SQL} SELECT w.plate_id, count(*) AS reads, max(r.place) AS last_place, arg_max(r.plate, (r.confidence, r.place)) FILTER (WHERE r.clean) AS canonical
FROM w JOIN r ON r.read_id = w.read_id WHERE w.plate_id IS NOT NULL GROUP BY w.plate_id""",
)
def canonical_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plate's reads, the last of them, and as its text the clean read of the most confidence, the later at ties."""
    reads, known = _plate_reads(spark, sf_dir)
    both = plates_matched(reads, known).where("plate_id is not null").join(reads, "read_id")
    text = F.max_by("plate", F.when(F.col("clean"), F.struct("confidence", "place")))
    return both.groupBy("plate_id").agg(F.count(F.lit(1)).alias("reads"), F.max("place").alias("last_place"), text.alias("canonical"))


#: Identities whose segments have enough near neighbours among each other are one up to this distance.
CLOSE = 0.545
_MERGED = f"""{_KNN}, ie AS (SELECT least(ia, ib) AS a, greatest(ia, ib) AS b FROM kn WHERE ia <> ib AND d <= {FAR} GROUP BY ALL HAVING count(*) >= {LINKS} AND round(min(d), 6) <= {CLOSE}), bo AS (SELECT a, b FROM ie UNION SELECT b, a FROM ie),
n AS (SELECT identity AS id, count(*) AS n, CASE WHEN identity % 4 = 1 THEN 'n' || identity END AS name FROM v WHERE identity IS NOT NULL GROUP BY identity), re AS (SELECT id, id AS r FROM n UNION SELECT re.id, bo.b FROM re JOIN bo ON bo.a = re.r),
cl AS (SELECT id, min(r) AS cluster FROM re GROUP BY id), ca AS (SELECT cluster, count(DISTINCT name) > 1 AS conflict, arg_max(id, (name IS NOT NULL, n, -id)) AS canonical FROM cl JOIN n USING (id) GROUP BY cluster),
su AS (SELECT id, cluster, conflict, CASE WHEN conflict THEN id ELSE canonical END AS survivor FROM cl JOIN ca USING (cluster))"""


def survivors(identities: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, cluster, conflict, survivor`` of ``identities(id, name, n)`` joined by ``edges(a, b)``: a cluster becomes its named member,
    else its largest, else that of the smallest id; one that holds two names is left alone."""
    found = components(edges.select("a", "b")).select("id", F.col("component").alias("cluster"))
    held = identities.join(found, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    best = F.struct(F.col("name").isNotNull().alias("named"), "n", (-F.col("id")).alias("minus"))
    chosen = held.groupBy("cluster").agg((F.countDistinct("name") > 1).alias("conflict"), F.max_by("id", best).alias("canonical"))
    return held.join(chosen, "cluster").select("id", "cluster", "conflict", F.when(F.col("conflict"), F.col("id")).otherwise(F.col("canonical")).alias("survivor"))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.col("identity").cast("long")
    v = vectors(spark, sf_dir).where("identity is not null").groupBy(identity.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    named = v.withColumn("name", F.when(F.col("id") % 4 == 1, F.concat(F.lit("n"), F.col("id").cast("string"))))
    edges = identity_edges(spark, sf_dir).where(F.col("distance") <= CLOSE).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return survivors(named, edges)


@query("canonical_identities", f"WITH RECURSIVE {_MERGED} SELECT id AS identity, cluster, conflict, survivor FROM su")
def canonical_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).withColumnRenamed("id", "identity")


@query(
    "merged_identities",
    f"""WITH RECURSIVE {_MERGED}, e AS (SELECT su.survivor, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM v JOIN su ON su.id = v.identity), m AS (SELECT survivor, i, avg(x) AS x, count(*) AS n FROM e GROUP BY ALL)
SELECT survivor AS identity, max(n) AS n, round(max(x) FILTER (WHERE i = 1) / sqrt(sum(x * x)), 6) AS first FROM m GROUP BY survivor""",
)
def merged_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities after the merge: segments follow the survivor, whose centroid is made anew from all that are now its own."""
    moved = vectors(spark, sf_dir).where("identity is not null").join(_survivors(spark, sf_dir).select(F.col("id").alias("identity"), "survivor"), "identity")
    c = centroids(moved, "survivor", "embedding")
    return c.select(F.col("survivor").alias("identity"), "n", F.round(F.element_at("centroid", 1), 6).alias("first"))


@query("healed_segments")
def healed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments linked by near neighbours, the nearest first, without ever joining two known identities: unattributed ones
    get the identity that their cluster holds."""
    near = nearest_segments(spark, sf_dir).where(F.col("distance") <= FAR).select("a", "b", "distance")
    names = vectors(spark, sf_dir).where("identity is not null").select(F.col("vec_id").alias("id"), F.concat(F.lit("n"), F.col("identity").cast("string")).alias("name"))
    return named_clusters(near, names)
