"""What streaming queries count, summed over all their batches: late rows, and what a plan observes."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Totals(StreamingQueryListener):
    """A listener that sums each query's dropped rows and observed counts as its batches end.

    A query's own recent progress holds its last batches only; the listener is told of every batch. Use it as a context:
    with Totals(spark) as totals: ...; totals.late_rows(query). A sum is there once the query has ended, for as long as
    the context lasts; `late_so_far` can be asked at any time, as of the batches of which word has come.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.late: dict[str, int] = defaultdict(int)
        self.seen: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.batches: dict[str, int] = defaultdict(int)
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def __enter__(self) -> Totals:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = str(progress.runId)
        self.batches[run] += 1
        self.late[run] += sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        for row in progress.observedMetrics.values():
            for name, value in row.asDict().items():
                self.seen[run][name] += value or 0

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def _of(self, query: StreamingQuery, timeout: float) -> str:
        run = str(query.runId)
        if not self.ended[run].wait(timeout):
            raise TimeoutError(f"no word of the end of streaming query {run}")
        return run

    def late_so_far(self, query: StreamingQuery) -> int:
        return self.late[str(query.runId)]

    def late_rows(self, query: StreamingQuery, timeout: float = 60) -> int:
        """Rows that an ended query has dropped as later than its watermark.

        Spark drops before each stateful operator; an aggregation has combined its rows by then and counts what is left.
        """
        return self.late[self._of(query, timeout)]

    def observed(self, query: StreamingQuery, timeout: float = 60) -> dict[str, int]:
        """Sums over an ended query's batches of what its plan observes, by name."""
        return dict(self.seen[self._of(query, timeout)])
