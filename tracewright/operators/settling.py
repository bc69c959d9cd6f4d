"""Choices made in an order, each looking at the choices of a few earlier items: the distributed form of a sequential rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.operators.scratch import written

#: Links of undecided items that one task settles in order; while there are more, rounds settle items in parallel.
SETTLED_AT_ONCE = 200_000

Decide = Callable[[dict, list[dict]], tuple]


def _grouped(decide: Decide, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One decision for each run of rows ``own, link`` of the same item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, links = None, []
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                if own is None or r["own"]["item"] != own["item"]:
                    if own is not None:
                        made.append((own["item"], *decide(own, links)))
                    own, links = r["own"], []
                if r["link"] is not None:
                    links.append(r["link"])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, m, strict=True)) for m in made], schema)
        if own is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (own["item"], *decide(own, links)), strict=True))], schema)

    return run


def _in_order(decide: Decide, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Decisions one after the other: rows ``own, link`` come in the order of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def with_known(own: dict, links: list[dict]) -> tuple:
            made = decide(own, [link | known.get(link["before"], {}) for link in links])
            known[own["item"]] = dict(zip(schema.names[1:], made, strict=True))
            return made

        yield from _grouped(with_known, schema)(batches)

    return run


def settled_in_order(items: DataFrame, links: DataFrame, decide: Decide, out: str, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """``item`` and the columns ``out`` of each of ``items(item, place, ...)``, decided as if one after the other by ``place``.

    ``links(item, before, ...)`` name the earlier items that a choice looks at; ``before`` is null for what is known from
    the start. ``decide(item, links)`` gets both as dicts, a link with the columns ``out`` of the item before it, and
    must not depend on the order of the links. Each round settles every item that has no undecided one before it; when few
    links are left one task goes through the rest in order. The rounds are as many as the longest chain of undecided
    items, so links should be few: those that can change the choice."""
    kind = T.StructType([items.schema["item"], *T._parse_datatype_string(out).fields])
    schema, names = to_arrow_schema(kind), [f.name for f in kind.fields[1:]]
    links = written(links)
    rest, done = written(items), None

    def cells(of: DataFrame) -> DataFrame:
        """``own, link`` of items, with what is decided of the links' other ends."""
        far = links
        for n in names:
            far = far.withColumn(n, F.lit(None).cast(kind[n].dataType)) if done is None else far
        if done is not None:
            far = far.join(done.withColumnRenamed("item", "before"), "before", "left")
        link = far.select("item", F.struct(*(c for c in far.columns if c != "item")).alias("link"))
        return of.select("item", "place", F.struct(*of.columns).alias("own")).join(link, "item", "left")

    while True:
        waiting = links.join(rest.select(F.col("item").alias("before")), "before").join(rest.select("item"), "item", "left_semi")
        if waiting.count() <= at_once:
            last = cells(rest).coalesce(1).sortWithinPartitions("place", "item").select("own", "link").mapInArrow(_in_order(decide, schema), kind)
            return last if done is None else done.unionByName(last)
        ready = rest.join(waiting.select("item"), "item", "left_anti")
        made = cells(ready).repartition("item").sortWithinPartitions("item").select("own", "link").mapInArrow(_grouped(decide, schema), kind)
        done = written(made if done is None else done.unionByName(made))
        rest = written(rest.join(done.select("item"), "item", "left_anti"))
