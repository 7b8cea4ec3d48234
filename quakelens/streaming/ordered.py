"""Rows of keyed state in the order of their event times, whatever order the batches bring them in.

Times are microseconds since the epoch here, so that nothing depends on the session's time zone. A row waits in its key's
state until the watermark has passed it; the state asks to be called again for the earliest row that waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.state import GroupState


def waiting_and_new(waiting: list[list], frames: Iterator[pd.DataFrame], columns: list[str], state: GroupState) -> list[tuple]:
    """The rows that waited (a list for each column, time first) and those of this batch, by time."""
    rows = list(zip(*waiting, strict=True))
    if not state.hasTimedOut:
        for frame in frames:
            rows += frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)
    return sorted(rows, key=lambda r: r[0])


def split(rows: list[tuple], watermark_ms: int) -> tuple[list[tuple], list[tuple]]:
    """Rows that the watermark has passed, and those that must wait."""
    ready = sum(r[0] <= watermark_ms * 1000 for r in rows)
    return rows[:ready], rows[ready:]


def by_column(rows: list[tuple], n: int) -> list[list]:
    return [[r[i] for r in rows] for i in range(n)]


def call_again(state: GroupState, at_us: int) -> None:
    """Ask for a call once the watermark has passed a time."""
    state.setTimeoutTimestamp(max(-(-at_us // 1000), state.getCurrentWatermarkMs() + 1))
