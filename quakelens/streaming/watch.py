"""Watches with state: recovery, first crossing, silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quakelens.operators.governance import RECOVERY_FACTOR, RECOVERY_FLOOR, RECOVERY_RUN, RECOVERY_SECONDS
from quakelens.sources.staging import importable
from quakelens.streaming import ordered
from quakelens.streaming.keyed import Tables, prepared, processed

SECOND = 1_000_000
#: Watches are kept and advanced in so many buckets.
BUCKETS = 1024
#: A service that has crossed is remembered so long after its last crossing: longer than any bundle lasts.
FORGET_SECONDS = 7 * 86_400


class _Recovery(StatefulProcessor):
    """All watches of a bucket at once: a bucket's calls and state accesses do not grow with its watches.

    Rows that wait and the watches' states lie in the state as Arrow tables of bounded size, not as a state for each watch.
    """

    waiting_columns = {"watch": pa.string(), "us": pa.int64(), "value": pa.float64(), "baseline": pa.float64(), "acted_us": pa.int64()}
    state_columns = {"watch": pa.string(), "count": pa.int64(), "seen": pa.bool_(), "done": pa.bool_(), "deadline": pa.int64()}

    def __init__(self, run_length: int, seconds: float):
        self.run_length, self.seconds = run_length, int(seconds * SECOND)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.state = (Tables(handle, name, pa.schema(list(columns.items()))) for name, columns in (("waiting", self.waiting_columns), ("watches", self.state_columns)))

    def _advance(self, rows: pd.DataFrame, state: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What the rows that the watermark has passed give, and the watches from now on; rows are in the order of times."""
        first = rows[~rows["watch"].isin(state["watch"])].drop_duplicates("watch")
        opened = pd.DataFrame({"watch": first["watch"], "count": 0, "seen": False, "done": False, "deadline": first["acted_us"] + self.seconds})
        state = pd.concat([state, opened], ignore_index=True) if len(state) else opened.reset_index(drop=True)
        count, seen, done = (state[c].to_numpy(t, copy=True) for c, t in (("count", "int64"), ("seen", bool), ("done", bool)))
        # Readings that are missing neither count nor break a run; without a baseline they say nothing.
        ready = rows[(rows["us"] <= watermark) & rows["value"].notna() & rows["baseline"].notna()]
        of = pd.Index(state["watch"]).get_indexer(ready["watch"])
        by_watch = np.argsort(of, kind="stable")
        ready, of = ready.iloc[by_watch], of[by_watch]
        place, base = np.arange(len(of)), ready["baseline"].to_numpy()
        start = np.searchsorted(of, of)
        inside = ready["value"].to_numpy() <= np.where(base > 0, base * RECOVERY_FACTOR, RECOVERY_FLOOR)
        broken = np.maximum.accumulate(np.where(inside, -1, place))
        run = np.where(broken >= start, place - broken, place - start + 1 + count[of])
        held = np.flatnonzero((run >= self.run_length) & ~done[of])
        watches, at = np.unique(of[held], return_index=True)
        when = ready.iloc[held[at]]
        last = np.flatnonzero(np.diff(of, append=-1))
        count[of[last]], seen[of], done[watches] = run[last], True, True
        recovered = pd.DataFrame({"watch": when["watch"], "status": "recovered", "after_seconds": (when["us"] - when["acted_us"]) / SECOND})
        # No reading within the deadline can come any more once the watermark is past it, and the watch is forgotten.
        over = watermark > state["deadline"].to_numpy("int64")
        ended = pd.DataFrame({"watch": state["watch"][over & ~done], "status": np.where(seen, "not_recovered", "unknown")[over & ~done], "after_seconds": np.nan})
        found = pd.concat([f for f in (recovered, ended) if len(f)] or [recovered], ignore_index=True)
        return found, state.assign(count=count, seen=seen, done=done)[~over]

    def _step(self, new: list[pd.DataFrame], timers) -> pd.DataFrame:
        watermark = timers.getCurrentWatermarkInMs() * 1000
        held = self.waiting.get()
        rows = [f for f in (held, *(f[list(self.waiting_columns)] for f in new)) if len(f)]
        rows = pd.concat(rows, ignore_index=True).sort_values("us", kind="stable") if rows else held
        found, state = self._advance(rows, self.state.get(), watermark)
        later = rows[rows["us"] > watermark]
        if len(later) == len(rows):
            self.waiting.add(later.iloc[:0] if not new else pd.concat(new)[list(self.waiting_columns)])
        else:
            self.waiting.put(later)
        self.state.put(state)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        times = [int(t) for t in (state["deadline"].min() + 1000, later["us"].min()) if pd.notna(t)]
        if times:
            # A timer goes off once the watermark is past it: the last millisecond before the time.
            self.handle.registerTimer(max(-(-min(times) // 1000) - 1, timers.getCurrentWatermarkInMs()))
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield self._step(list(rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step([], timerValues)

    def close(self) -> None:
        pass


def recovery_watch(signal: DataFrame, run_length: int = RECOVERY_RUN, seconds: float = RECOVERY_SECONDS, lateness: str = "30 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Recovered, not_recovered or unknown, once for each watch (watch, at, value, baseline, acted_at); at the deadline in event time at the latest.

    A watch opens with any row from the action to the deadline, such as one without a value at the action itself; rows
    outside that time only move the watermark. Readings count in the order of their times. Watches are dealt to `buckets`
    by hash, each of which is advanced as a whole; a query keeps the number that it was started with.
    """
    prepared(signal.sparkSession)
    rows = signal.withWatermark("at", lateness).withColumns({"us": F.unix_micros("at"), "acted_us": F.unix_micros("acted_at")})
    rows = rows.filter((F.col("us") >= F.col("acted_us")) & (F.col("us") <= F.col("acted_us") + int(seconds * SECOND)))
    values = {c: F.when(~F.isnan(c), F.col(c).cast("double")) for c in ("value", "baseline")}
    rows = rows.withColumns(values).withColumn("watch", F.col("watch").cast("string"))
    rows = rows.select(F.pmod(F.xxhash64("watch"), F.lit(buckets)).alias("bucket"), "at", *_Recovery.waiting_columns)
    return processed(rows.groupBy("bucket"), _Recovery(run_length, seconds), "watch string, status string, after_seconds double")


class _First(StatefulProcessor):
    """The earliest crossing of a service; only that, whether it has been told, and the latest crossing are kept."""

    def __init__(self, forget: int):
        self.forget = forget * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("crossing", "onset bigint, told boolean, last bigint")

    def _step(self, key: tuple, times: list[int], timers) -> pd.DataFrame:
        onset, told, last = self.state.get() if self.state.exists() else (None, False, None)
        last = max([*times, *([] if last is None else [last])])
        if not told:
            onset = min([*times, *([] if onset is None else [onset])])
        watermark = timers.getCurrentWatermarkInMs() * 1000
        out = []
        # Only once the watermark has passed it can no earlier crossing come.
        if not told and onset <= watermark:
            told = True
            out.append((*key, onset))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if told and watermark > last + self.forget:
            self.state.clear()
        else:
            self.state.update((onset, told, last))
            self.handle.registerTimer(max(-(-(onset if not told else last + self.forget + 1000) // 1000) - 1, timers.getCurrentWatermarkInMs()))
        return pd.DataFrame(out, columns=["bundle_id", "service_name", "us"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield self._step(key, [t for f in rows for t in (int(f["us"].min()), int(f["us"].max()))], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step(key, [], timerValues)

    def close(self) -> None:
        pass


def first_crossings(facts: DataFrame, baseline: DataFrame, threshold: float = 3.0, lateness: str = "30 seconds", forget: int = FORGET_SECONDS) -> DataFrame:
    """The first sample of each service over its static baseline (bundle_id, service_name, metric_name, median, scale).

    A service is forgotten `forget` seconds of event time after its last crossing, so at the latest that long after its
    bundle's last sample; it is told once as long as no bundle has two crossings of a service further apart than that.
    """
    prepared(facts.sparkSession)
    over = facts.withWatermark("timestamp", lateness).join(baseline, ["bundle_id", "service_name", "metric_name"]).filter((F.col("value") - F.col("median")) / F.col("scale") >= threshold)
    keyed = over.select("bundle_id", "service_name", "timestamp", F.unix_micros("timestamp").alias("us")).groupBy("bundle_id", "service_name")
    found = processed(keyed, _First(forget), "bundle_id string, service_name string, us long")
    return found.select("bundle_id", "service_name", F.timestamp_micros("us").alias("onset_at"))


def _silence(seconds: int):
    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out = [(key[0], state.get[0])]
            state.remove()
        else:
            last = max([*(int(f["us"].max()) for f in frames if len(f)), *(state.getOption or ())])
            state.update((last,))
            ordered.call_again(state, last + seconds * SECOND)
        yield pd.DataFrame(out, columns=["bundle_id", "us"])

    return run


def silences(facts: DataFrame, seconds: int = 120, lateness: str = "30 seconds") -> DataFrame:
    """Bundles from which nothing has come for some time of event time."""
    importable(facts.sparkSession)
    found = facts.withWatermark("timestamp", lateness).withColumn("us", F.unix_micros("timestamp")).groupBy("bundle_id").applyInPandasWithState(
        _silence(seconds), "bundle_id string, us long", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("bundle_id", F.timestamp_micros("us").alias("silent_since"))
