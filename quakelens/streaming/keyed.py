"""Processors of one key's rows in the order of their event times, with state that ends.

Rows wait in a list state until the watermark has passed them; what the key knows is in a value state; one event-time timer
a key calls it again for the earliest row that waits, or when its state is to go. Times are microseconds since the epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quakelens.sources.staging import importable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    """State with timers is kept by RocksDB; a query keeps the provider that it was started with."""
    importable(spark)
    spark.conf.set(PROVIDER, ROCKS)


class InOrder(StatefulProcessor):
    """A key's rows by time. Subclasses say what they read, keep and give, and how a key goes on."""

    #: The columns that are read, time first, as they are kept while they wait; the value state; the columns given.
    columns: list[str]
    waiting_schema: str
    state_schema: str
    given: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def advance(self, key: tuple, state: tuple | None, ready: list[tuple], waiting: list[tuple], watermark: int) -> tuple[list[tuple], tuple | None, int | None]:
        """Rows to give, the state from now on (None: the key is forgotten) and when to call again besides for waiting rows."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            frame = frame[self.columns]
            new += frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
        yield self._step(key, new, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step(key, [], timerValues)

    def close(self) -> None:
        pass

    def _step(self, key: tuple, new: list[tuple], timers) -> pd.DataFrame:
        watermark = timers.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted(held + new, key=lambda r: r[0])
        passed = sum(r[0] <= watermark for r in rows)
        out, state, again = self.advance(key, self.state.get() if self.state.exists() else None, rows[:passed], rows[passed:], watermark)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        later = rows[passed:]
        if later:
            if len(later) != len(held) or new:
                self.waiting.put(later)
        elif held:
            self.waiting.clear()
        if state is not None:
            self.state.update(state)
        elif self.state.exists():
            self.state.clear()
        times = [t for t in (again if state is not None else None, later[0][0] if later else None) if t is not None]
        if times:
            # A timer goes off once the watermark is past it: the last millisecond before the time.
            self.handle.registerTimer(max(-(-min(times) // 1000) - 1, timers.getCurrentWatermarkInMs()))
        return pd.DataFrame(out, columns=self.given)


#: Rows of one Arrow table in the state.
PIECE_ROWS = 10_000


class Tables:
    """Many rows of one key's state, as Arrow tables of at most PIECE_ROWS rows in a list state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema):
        self.schema, self.pieces = schema, handle.getListState(name, "piece binary")

    def get(self) -> pd.DataFrame:
        pieces = self.pieces.get() if self.pieces.exists() else ()
        tables = [pa.ipc.open_stream(bytes(p[0])).read_all() for p in pieces]
        return pa.concat_tables([self.schema.empty_table(), *tables]).to_pandas()

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.pieces.appendList(self._pieces(rows))

    def put(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.pieces.put(self._pieces(rows))
        elif self.pieces.exists():
            self.pieces.clear()

    def _pieces(self, rows: pd.DataFrame) -> list[tuple]:
        table, found = pa.Table.from_pandas(rows, self.schema, preserve_index=False), []
        for batch in table.to_batches(PIECE_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as out:
                out.write_batch(batch)
            found.append((bytearray(sink.getvalue().to_pybytes()),))
        return found


def processed(rows: GroupedData, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The processor's rows, in append mode and event time."""
    return rows.transformWithStateInPandas(processor, schema, "append", "EventTime")
