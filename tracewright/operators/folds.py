"""Folds in order over the rows of a key, for what depends on a choice made at an earlier row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows of a task, about, where it sorts or groups all that it holds.
ROWS = 500_000


def spread(rows: DataFrame, *keys: str, n: int | None = None, most: int | None = None) -> DataFrame:
    """``rows`` dealt by ``keys`` into as many parts as their number (``n``, if it is known) asks for, so that a task's memory
    does not grow with the table; a table that Spark's own number of parts suits is returned as it is."""
    parts = -(-(rows.count() if n is None else n) // (most or ROWS))
    return rows if parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(parts, *keys)


def folded(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], name: str, kind: T.DataType, step: Callable) -> DataFrame:
    """Adds ``name``: the value of ``state, value = step(state, *inputs)`` over each key's rows in ``order``.

    The state is None at a key's first row. Rows are dealt by key and sorted, and a task goes through many keys in one call
    with one state, whatever the length of a key."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, *inputs)]
            values = []
            for row in zip(*columns, strict=True):
                if row[: len(keys)] != key:
                    key, state = row[: len(keys)], None
                state, value = step(state, *row[len(keys) :])
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, name])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))
