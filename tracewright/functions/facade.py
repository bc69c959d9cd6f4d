"""The library's functions under names of their own in SQL, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewright.functions.text import CONFUSED, COUNTS_AS

FUNCTIONS = {
    "plate_key": ("s STRING", "STRING", "upper(regexp_replace(s, '[^A-Za-z0-9]', ''))"),
    "fold_confusables": ("s STRING", "STRING", f"translate(s, '{CONFUSED}', '{COUNTS_AS}')"),
    "cosine_distance": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))",
    ),
    "month_of": ("ns BIGINT", "STRING", "date_format(timestamp_micros(ns div 1000), 'yyyy-MM')"),
}


def register(spark: SparkSession) -> None:
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
