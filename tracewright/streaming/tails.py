"""Open tails as keyed state: blocks of sentences and sessions that stay open until silence closes them.

The processors hold rows of one key that may still grow; a timer closes them. They need the RocksDB state store, which
``stateful`` sets for the job that it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MILLI = 1_000_000


class stateful:
    """Within it, jobs of the session are started with the state store that keyed timers need."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE, None)
        self.spark.conf.set(STORE, ROCKS)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.unset(STORE) if self.before is None else self.spark.conf.set(STORE, self.before)


class BlockTail(StatefulProcessor):
    """Sentences of a device, given out block by block: a block ends where the next start is more than ``gap`` after the end of
    the last row, and is given out once the watermark is past that, so no row that is still to come belongs to it."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "id long, speaker string, start_ns long, end_ns long")

    def close(self) -> None:
        pass

    def _kept(self, rows: list[tuple]) -> None:
        self.rows.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.rows.put(rows)
            first_end = self._blocks(rows)[0][-1][3]
            self.handle.registerTimer((first_end + self.gap) // MILLI + 1)

    def _blocks(self, rows: list[tuple]) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for r in sorted(rows, key=lambda r: (r[2], r[0])):
            if not out or r[2] - out[-1][-1][3] > self.gap:
                out.append([])
            out[-1].append(r)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        for batch in rows:
            held += [(int(r.id), r.speaker if isinstance(r.speaker, str) else None, int(r.start_ns), int(r.end_ns)) for r in batch.itertuples(index=False)]
        self._kept(held)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * MILLI
        blocks = self._blocks([tuple(r) for r in self.rows.get()])
        done = [b for b in blocks if b[-1][3] + self.gap < mark]
        self._kept([r for b in blocks[len(done) :] for r in b])
        out = [(key[0], b[0][0], *r) for b in done for r in b]
        yield pd.DataFrame(out, columns=["device", "block", "id", "speaker", "start_ns", "end_ns"])


def closed_blocks(sentences: DataFrame, gap: int, delay: str = "10 seconds") -> DataFrame:
    """Rows of closed blocks of a stream ``sentences(device long, id, speaker, start_ns, end_ns)``, each with its block's first id."""
    timed = sentences.withColumn("at", F.timestamp_micros(F.expr("start_ns div 1000"))).withWatermark("at", delay)
    return timed.groupBy("device").transformWithStateInPandas(BlockTail(gap), "device long, block long, id long, speaker string, start_ns long, end_ns long", "Append", "EventTime")


class TwoClocks(StatefulProcessor):
    """A conversation's rows counted until it is silent for ``gap`` and ``grace`` by the rows' own clock and untouched for
    ``grace`` by the wall's; then one row tells its close, and rows that come later begin anew."""

    def __init__(self, gap: int, grace: int) -> None:
        self.gap, self.grace = gap, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "start_ns long, end_ns long, n long, touched_ms long")

    def close(self) -> None:
        pass

    def _due(self, end_ns: int, touched_ms: int) -> int:
        return max((end_ns + self.gap + self.grace) // MILLI, touched_ms + self.grace // MILLI) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        start, end, n = (*self.state.get()[:3],) if self.state.exists() else (2**63 - 1, -(2**63), 0)
        for batch in rows:
            start, end, n = min(start, int(batch.start_ns.min())), max(end, int(batch.end_ns.max())), n + len(batch)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.state.update((start, end, n, now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._due(end, now))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            yield pd.DataFrame()
            return
        start, end, n, touched = self.state.get()
        due = self._due(end, touched)
        if due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
            yield pd.DataFrame()
            return
        self.state.clear()
        yield pd.DataFrame([(key[0], start, end, n)], columns=["conversation", "start_ns", "end_ns", "n"])


def closes(rows: DataFrame, gap: int, grace: int) -> DataFrame:
    """One row for each closed conversation of a stream ``rows(conversation string, start_ns, end_ns)``."""
    return rows.groupBy("conversation").transformWithStateInPandas(TwoClocks(gap, grace), "conversation string, start_ns long, end_ns long, n long", "Append", "ProcessingTime")
