"""Text functions on columns: normalisation, plates, similarity, names, labels and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that cameras confuse and what they count as, fixed values.
CONFUSED, COUNTS_AS = "OQDILBSZG", "000118526"


def plain(s: Column) -> Column:
    """Lower case; every run of other signs than letters and digits is one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def plate_key(s: Column) -> Column:
    """ASCII letters and digits in upper case."""
    return F.upper(F.regexp_replace(s, "[^A-Za-z0-9]", ""))


def fold_confusables(s: Column) -> Column:
    return F.translate(s, CONFUSED, COUNTS_AS)


def trigrams(s: Column) -> Column:
    """Distinct trigrams of each word, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all, of two arrays of trigrams."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def truncated(s: Column, most: int) -> Column:
    """At most ``most`` characters, the cut marked by an ellipsis."""
    s = F.trim(s)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most)), F.lit("…"))).otherwise(s)


def sentences(s: Column) -> Column:
    """Sentences with their full stop, question or exclamation mark; the rest of a text is one too."""
    return F.filter(F.transform(F.regexp_extract_all(s, F.lit("[^.?!]+[.?!]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x.rlike("[A-Za-z0-9]"))


def duration_phrase(seconds: Column) -> Column:
    h, m = F.expr("1") * 0 + F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h.cast("long"), m.cast("long"))).when(m > 0, F.format_string("%dm", m.cast("long"))).otherwise(F.format_string("%ds", seconds.cast("long")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def label_of_reply(s: Column, labels: list[str]) -> Column:
    """The one label that occurs as a word; null if none or several do."""
    found = F.array_intersect(F.split(plain(s), " "), F.array(*(F.lit(x) for x in labels)))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def severity_rank(s: Column, ranks: tuple[str, ...] = ("info", "warning", "critical")) -> Column:
    """From 1; what is not known ranks lowest."""
    return F.greatest(F.array_position(F.array(*(F.lit(x) for x in ranks)), s), F.lit(1)).cast("int")


def packed_paragraphs(body: Column, target: int) -> Column:
    """Paragraphs joined greedily into chunks of up to ``target`` characters (two for a joint); none is split."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc, p):
        fits = F.length(acc["open"]) + F.length(p) + 2 <= target
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open"))
        fresh = F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), p.alias("open"))
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), p.alias("open"))).when(fits, joined).otherwise(fresh)

    return F.aggregate(F.filter(F.split(body, "\n+"), lambda p: F.trim(p) != ""), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
