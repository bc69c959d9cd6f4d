"""Spark-native analytics over time-stamped recordings and the facts derived from them."""
