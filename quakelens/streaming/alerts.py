"""Holding, grouping and delivering alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quakelens.sources.staging import importable
from quakelens.sources.writers import MICROSECONDS
from quakelens.streaming import ordered
from quakelens.streaming.keyed import InOrder, prepared, processed

HOLD_SECONDS, GROUP_GAP, REPEAT = 120, "30 seconds", "1 hour"
FORGET_SECONDS = 7 * 86_400
WAIT_SECONDS, INTERVAL_SECONDS, REPEAT_SECONDS = 10, 30, 3600  # fixed values
SECOND = 1_000_000
_CHANGED = "rule string, service_name string, us long, status string"
_SENT = "rule string, service_name string, us long, status string"


class _Hold(InOrder):
    columns, waiting_schema = ["us", "firing"], "us bigint, firing boolean"
    state_schema = "since bigint, fired boolean, last bigint"
    given = ["rule", "service_name", "us", "status"]

    def __init__(self, seconds: int, forget: int):
        self.seconds, self.forget = seconds * SECOND, forget * SECOND

    def advance(self, key, state, ready, waiting, watermark):
        since, fired, last = state or (None, False, None)
        out = []
        for at, firing in ready:
            last = at
            if not firing:
                if fired:
                    out.append((*key, at, "resolved"))
                since, fired = None, False
                continue
            since = at if since is None else since
            if not fired and at - since >= self.seconds:
                fired = True
                out.append((*key, at, "firing"))
        # A condition that is false needs no state, nor does one of which nothing has come for long.
        if since is None or not waiting and watermark > last + self.forget:
            return out, None, None
        return out, (since, fired, last), last + self.forget + 1000


def changes_stream(samples: DataFrame, seconds: int = HOLD_SECONDS, lateness: str = "30 seconds", forget: int = FORGET_SECONDS) -> DataFrame:
    """A row when a condition (rule, service_name, at, firing) has been true for some time without a break, and one when it ends.

    Samples are taken in the order of their times once the watermark has passed them, so late ones count where they belong.
    A condition of which no sample has come for `forget` seconds of event time is forgotten without a row.
    """
    prepared(samples.sparkSession)
    rows = samples.withWatermark("at", lateness).withColumns({"us": F.unix_micros("at"), "firing": F.coalesce("firing", F.lit(False))})
    found = processed(rows.groupBy("rule", "service_name"), _Hold(seconds, forget), _CHANGED)
    return found.select("rule", "service_name", F.timestamp_micros("us").alias("at"), "status")


def held_stream(samples: DataFrame, seconds: int = HOLD_SECONDS, lateness: str = "30 seconds") -> DataFrame:
    """One row when a condition has been true for some time without a break."""
    return changes_stream(samples, seconds, lateness).filter("status = 'firing'").select("rule", "service_name", F.col("at").alias("fired_at"))


def _runs(samples: DataFrame) -> DataFrame:
    of = Window.partitionBy("rule", "service_name").orderBy("at")
    firing = F.coalesce("firing", F.lit(False))
    return samples.withColumn("firing", firing).withColumn("run", F.sum(F.when(F.col("firing"), 0).otherwise(1)).over(of.rowsBetween(Window.unboundedPreceding, 0)))


def held(samples: DataFrame, seconds: int = HOLD_SECONDS) -> DataFrame:
    """R6 on a table: runs of true samples between false ones, and when each first lasted long enough."""
    since = F.min("at").over(Window.partitionBy("rule", "service_name", "run"))
    long_ = _runs(samples).filter("firing").withColumn("since", since).filter((F.unix_micros("at") - F.unix_micros("since")) >= seconds * SECOND)
    return long_.groupBy("rule", "service_name", "run").agg(F.min("at").alias("fired_at")).select("rule", "service_name", "fired_at")


def changes(samples: DataFrame, seconds: int = HOLD_SECONDS) -> DataFrame:
    """R6 on a table: when each alert fired and when it was resolved, as changes_stream gives them."""
    key = ["rule", "service_name"]
    runs = _runs(samples)
    since = F.min(F.when(F.col("firing"), F.col("at"))).over(Window.partitionBy(*key, "run"))
    long_ = runs.withColumn("since", since).filter(F.col("firing") & (F.unix_micros("at") - F.unix_micros("since") >= seconds * SECOND))
    fired = long_.groupBy(*key, "run").agg(F.min("at").alias("at"))
    ends = runs.filter("not firing").select(*key, (F.col("run") - 1).alias("run"), "at")
    resolved = ends.join(fired.select(*key, "run"), [*key, "run"], "left_semi")
    return fired.select(*key, "at", F.lit("firing").alias("status")).unionByName(resolved.select(*key, "at", F.lit("resolved").alias("status")))


def grouped(fired: DataFrame, gap: str = GROUP_GAP, lateness: str = "1 minute") -> DataFrame:
    """Alerts of one rule and service that follow each other within a gap, as one session."""
    rows = fired.withWatermark("fired_at", lateness) if fired.isStreaming else fired
    found = rows.groupBy(F.session_window("fired_at", gap).alias("w"), "rule", "service_name").agg(F.count("*").alias("alerts"))
    return found.select("rule", "service_name", F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"), "alerts")


def without_repeats(fired: DataFrame, repeat: str = REPEAT) -> DataFrame:
    """An alert of one rule and service once within the repeat interval."""
    return fired.withWatermark("fired_at", repeat).dropDuplicatesWithinWatermark(["rule", "service_name"])


def _notify(wait: int, interval: int, repeat: int):
    wait, interval, repeat = wait * SECOND, interval * SECOND, repeat * SECOND

    def run(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # tick: the group's next look at its alert; sent: the last delivery, and told: what it said; firing: how things stand.
        *waiting, tick, sent, told, firing = state.get if state.exists else ([], [], None, None, None, False)
        rows = ordered.waiting_and_new(waiting, frames, ["us", "status"], state)
        watermark = state.getCurrentWatermarkMs()
        ready, later = ordered.split(rows, watermark)
        out = []

        def look(until: int) -> None:
            """All looks before a time; those at which nothing can happen are passed over at once."""
            nonlocal tick, sent, told
            while tick is not None and tick < until:
                status = "firing" if firing else "resolved"
                if not firing and told is None:  # over before anyone heard of it
                    tick = None
                elif told != status or (firing and tick - sent >= repeat):
                    out.append((*key, tick, status))
                    sent, told = tick, status
                    tick = tick + interval if firing else None
                else:
                    tick += interval * max(1, -(-(min(sent + repeat, until) - tick) // interval))
                if tick is None:
                    sent = told = None

        for at, status in ready:
            look(at)
            firing = status == "firing"
            if firing and tick is None:
                tick = at + wait
        look(watermark * 1000 + 1)
        if later or tick is not None:
            state.update((*ordered.by_column(later, 2), tick, sent, told, firing))
            ordered.call_again(state, min([r[0] for r in later[:1]] + ([tick] if tick is not None else [])))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["rule", "service_name", "us", "status"])

    return run


def notifications(changed: DataFrame, wait: int = WAIT_SECONDS, interval: int = INTERVAL_SECONDS, repeat: int = REPEAT_SECONDS, lateness: str = "30 seconds") -> DataFrame:
    """Deliveries of each group (rule, service_name) of alerts (at, status firing or resolved), a stream in event time.

    A group is first looked at `wait` seconds after its first alert, then at each interval. A look delivers what has
    changed since the last delivery, or what still fires after the repeat interval; an alert that ended before its first
    delivery is never delivered. A group ends with the delivery of its resolution.
    """
    importable(changed.sparkSession)
    rows = changed.withWatermark("at", lateness).withColumn("us", F.unix_micros("at"))
    state = "waiting array<bigint>, statuses array<string>, tick bigint, sent bigint, told string, firing boolean"
    found = rows.groupBy("rule", "service_name").applyInPandasWithState(_notify(wait, interval, repeat), _SENT, state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("rule", "service_name", F.timestamp_micros("us").alias("sent_at"), "status")


def deliver(fired: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Alerts as JSON lines with the time of delivery."""
    return fired.withColumn("received_at", F.current_timestamp()).writeStream.format("json").option("timestampFormat", MICROSECONDS).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
