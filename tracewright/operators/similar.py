"""Pairs of sets that share most of their members, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Sets whose keys a task makes and compares, about.
SETS = 20_000
#: Members that a set's key joins; a set makes fewer keys of longer prefixes with fewer.
TOGETHER = ((5, 3), (9, 2))


def _subsets(prefix: Column, level: Column) -> Column:
    """All choices of ``level`` members of an ordered array, in its order."""
    after = lambda i: F.slice(prefix, i + 2, F.size(prefix))
    pairs = F.flatten(F.transform(prefix, lambda x, i: F.transform(after(i), lambda y: F.array(x, y))))
    triples = F.flatten(F.transform(prefix, lambda x, i: F.flatten(F.transform(after(i), lambda y, j: F.transform(after(i + j + 1), lambda z: F.array(x, y, z))))))
    return F.when(level == 3, triples).when(level == 2, pairs).otherwise(F.transform(prefix, lambda x: F.array(x)))


def similar_sets(rows: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` (a < b) of ``rows(id, items)`` whose shared members are at least ``least`` of all of both.

    Of two such sets with n members each shares t = ceil(least * n) or more with the other. In the order of how rare
    members are, the first l shared ones lie among the first n - t + l of each, so both have a key of l members in common.
    Keys of up to three members bring few sets together that are not alike, where single ones bring all that share a member;
    each set makes keys of the lengths that sets of the sizes near its own make. What is found is compared in full.

    Keys are many for each set, so sets are dealt into parts before they are made, and sets with a key in common meet by one
    shuffle of the keys: no side of them is broadcast. Two sets are looked at in full if the bits of their members' hashes,
    64 for each set, do not tell already that they are not alike."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SETS))
    most = lambda n: F.ceil(n * least - 1e-9)

    def level(n: Column) -> Column:
        free, found = n - most(n), F.lit(1)
        for spare, members in reversed(TOGETHER):
            found = F.when(free <= spare, members).otherwise(found)
        return F.greatest(F.least(found, most(n)), F.lit(1)).cast("int")

    keyed = rows.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    rarity = keyed.groupBy("item").agg(F.count(F.lit(1)).alias("f"))
    ordered = keyed.join(rarity, "item").repartition(parts, "id").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("ordered"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    ordered = ordered.withColumn("bits", F.aggregate("ordered", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x["item"]))))
    n = F.col("n")
    levels = F.array_distinct(F.transform(F.sequence(F.greatest(most(n), F.lit(1)), F.greatest(F.floor(n / least + 1e-9), F.lit(1))), level))
    first = ordered.select("id", "n", "bits", F.transform("ordered", lambda r: r["item"]).alias("ordered"), F.explode(levels).alias("level"))
    first = first.withColumn("prefix", F.slice("ordered", F.lit(1), (n - most(n) + F.col("level")).cast("int")))
    # Keys that fall together by their hash are told apart below, where sets are compared.
    first = first.select("id", "n", "bits", F.explode(F.transform(_subsets(F.col("prefix"), F.col("level")), lambda k: F.xxhash64(k))).alias("key")).repartition(parts, "key")
    a, b = (first.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"), "key") for s in "ab")
    # Members of one set only are at most this many in two sets that are alike; each sets no more than one bit of its set apart.
    apart = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= (F.col("n_a") + F.col("n_b")) * ((1 - least) / (1 + least)) + 1e-6
    near = a.join(b.hint("merge"), "key").where("a < b").where(apart).where((F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9)).select("a", "b").distinct()
    x, y = (rows.select(F.col("id").alias(s), F.col("items").alias(f"items_{s}")) for s in "ab")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    sized = near.join(x, "a").join(y, "b").withColumn("shared", shared)
    return sized.withColumn("similarity", F.col("shared") / (F.size("items_a") + F.size("items_b") - F.col("shared"))).where(F.col("similarity") >= least - 1e-9).select("a", "b", "similarity")
