"""Windowed rates, quantiles and pairs that run on streams and on tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quakelens.functions.columns import injection_categories, mask_log

LATENESS, STEP, SPAN = "30 seconds", "15 seconds", "5 minutes"
TTL, UNKNOWN = "10 seconds", "unknown"  # fixed values
LEAST_REQUESTS, ERROR_LIMIT, LATENCY_LIMIT, EDGE_LIMIT = 0.001, 0.05, 1000.0, 0.10  # fixed values


def _late(rows: DataFrame, column: str, lateness: str) -> DataFrame:
    """Rows later than the watermark are dropped, and counted by totals.Totals; tables drop nothing."""
    return rows.withWatermark(column, lateness) if rows.isStreaming else rows


def red(spans: DataFrame, step: str = STEP, lateness: str = LATENESS) -> DataFrame:
    """Calls by service and status in tumbling windows."""
    rows = _late(spans, "start_time", lateness)
    return rows.groupBy(F.window("start_time", step).alias("w"), "service_name", "status_code").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("window_start"), "service_name", "status_code", "calls")


def error_ratios(spans: DataFrame, span: str = SPAN, step: str = STEP, lateness: str = LATENESS, limit: float = ERROR_LIMIT, keys: tuple[str, ...] = ("service_name",)) -> DataFrame:
    """R2: share of failed calls in sliding windows, and whether it is over the limit; R4 with keys client and server."""
    rows = _late(spans, "start_time", lateness)
    counts = rows.groupBy(F.window("start_time", span, step).alias("w"), *keys).agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") == "ERROR").alias("failures"))
    ratio = F.col("failures") / F.greatest(F.col("calls").cast("double"), F.lit(LEAST_REQUESTS))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "calls", F.round(ratio, 6).alias("ratio"), (ratio > limit).alias("firing"))


def slow_services(spans: DataFrame, span: str = SPAN, step: str = STEP, lateness: str = LATENESS, limit: float = LATENCY_LIMIT) -> DataFrame:
    """95th percentile of durations in sliding windows, and whether it is over the limit."""
    rows = _late(spans, "start_time", lateness)
    found = rows.groupBy(F.window("start_time", span, step).alias("w"), "service_name").agg(F.percentile_approx("duration_ms", 0.95, 10_000).alias("p95_ms"))
    return found.select(F.col("w.start").alias("window_start"), "service_name", "p95_ms", (F.col("p95_ms") > limit).alias("firing"))


def _sides(callers: DataFrame, called: DataFrame, ttl: str, lateness: str, *flags: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides and when they meet; `flags` are columns that go along, as call_ and span_ of that name."""
    more = [[F.col(c).alias(f"{side}_{c}") for c in flags] for side in ("call", "span")]
    a = _late(callers.select("trace_id", F.col("span_id").alias("parent"), F.col("service_name").alias("client"), F.col("start_time").alias("called_at"), *more[0]), "called_at", lateness)
    b = _late(called.select(F.col("trace_id").alias("trace"), F.col("parent_span_id"), F.col("service_name").alias("server"), "start_time", "duration_ms", "status_code", *more[1]), "start_time", lateness)
    near = F.expr(f"trace_id = trace and parent = parent_span_id and start_time >= called_at - interval {ttl} and start_time <= called_at + interval {ttl}")
    return a, b, near


def _met(a: DataFrame, b: DataFrame, near: Column, *flags: str) -> DataFrame:
    """Pairs, and the spans of both sides that have none, which `lone_call` and `lone_span` tell."""
    return a.join(b, near, "full_outer").select(
        F.coalesce("trace_id", "trace").alias("trace_id"), F.coalesce("client", F.lit(UNKNOWN)).alias("client"), F.coalesce("server", F.lit(UNKNOWN)).alias("server"),
        F.coalesce("start_time", "called_at").alias("start_time"), "duration_ms", "status_code", F.col("parent_span_id").isNull().alias("lone_call"), F.col("parent").isNull().alias("lone_span"), *flags,
    )


def paired(callers: DataFrame, called: DataFrame, ttl: str = TTL, lateness: str = LATENESS) -> DataFrame:
    """Calling and called spans of one trace within a time to live."""
    a, b, near = _sides(callers, called, ttl, lateness)
    return a.join(b, near).select("trace_id", "client", "server", "start_time", "duration_ms", "status_code")


def paired_or_unknown(callers: DataFrame, called: DataFrame, ttl: str = TTL, lateness: str = LATENESS) -> DataFrame:
    """Pairs as `paired` has them, and once each calling or called span that finds no partner within the time to live.

    The side that is missing is `unknown`. On a stream a span without partner is given when the watermark has passed the last
    time at which one could come, and its state goes with it. Called spans without a parent's id are roots: nobody called
    them, and they are left out. Batches observe `matched`, `unknown_server` and `unknown_client`, which totals.Totals sums.
    """
    both = _met(*_sides(callers, called.filter("parent_span_id is not null"), ttl, lateness))
    counts = [F.count_if(~F.col("lone_call") & ~F.col("lone_span")).alias("matched"), F.count_if("lone_call").alias("unknown_server"), F.count_if("lone_span").alias("unknown_client")]
    return both.observe("pairs", *counts).drop("lone_call", "lone_span")


def _watermark(ends: list[tuple[int | None, int | None]], lateness: str) -> Column | None:
    """The time up to which both sides are complete, in whole milliseconds as Spark keeps it; none if a side has no rows."""
    last = [max((x for x in side if x is not None), default=None) for side in zip(*ends, strict=True)]
    return None if None in last else F.timestamp_micros(F.lit(min(last) // 1000 * 1000)) - F.expr(f"interval {lateness}")


def _ends(rows: DataFrame) -> tuple[int | None, int | None]:
    """The last time of each side in microseconds."""
    last = F.unix_micros("start_time")
    return tuple(rows.agg(F.max(F.when(F.col("calls"), last)), F.max(F.when(~F.col("calls"), last))).first())


def paired_in_batches(callers: DataFrame, called: DataFrame, path: str, ttl: str = TTL, lateness: str = LATENESS) -> DataStreamWriter:
    """What `paired_or_unknown` gives for two streams, for large batches: each is paired by a plain join, not row by row with a state.

    Results are files under `path`/pairs, a folder for each batch; a batch that comes again after a failure replaces what it
    gave. A span is decided in the batch whose watermark passes the last time at which a partner could come. Its partners
    lie a time to live before it at the earliest, so spans of two times to live before the watermark wait under
    `path`/waiting for the next batch, and all others are gone. Late rows are dropped. Spans without a trace have no partner,
    as in a table; Spark's join with state takes null traces for equal.
    """
    calls = callers.select(F.lit(True).alias("calls"), "trace_id", "span_id", "service_name", "start_time")
    served = called.filter("parent_span_id is not null").select(F.lit(False).alias("calls"), "trace_id", "parent_span_id", "service_name", "start_time", "duration_ms", "status_code")

    def step(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read.schema(batch.schema)
        # Two places in turn: a batch that is done again finds what the one before it left.
        here, last = (f"{path}/waiting/{n % 2}" for n in (number, number - 1))
        waiting = read.parquet(last) if number else batch.limit(0)
        ends = [_ends(waiting)] if number else []
        since, until = (_watermark(x, lateness) if x else None for x in (ends, [*ends, _ends(batch)]))
        new = batch if since is None else batch.filter(F.col("start_time") > since)
        # A pair is given where one of the two is new; a lone span once the watermark has passed its time to live.
        known = waiting.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
        life = F.expr(f"interval {ttl}")
        (known if until is None else known.filter(F.col("start_time") >= until - life - life)).drop("new").write.mode("overwrite").parquet(here)
        both = _met(*_sides(known.filter("calls"), known.filter("not calls"), ttl, lateness, "new"), "call_new", "span_new")
        lone = F.col("lone_call") | F.col("lone_span")
        decided = F.lit(False) if until is None else F.col("start_time") < until - life
        if since is not None:
            decided &= F.col("start_time") >= since - life
        given = both.filter(F.when(lone, decided).otherwise(F.col("call_new") | F.col("span_new"))).drop("lone_call", "lone_span", "call_new", "span_new")
        given.write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")

    return calls.unionByName(served, allowMissingColumns=True).writeStream.foreachBatch(step)


def unknown_calls(pairs: DataFrame) -> DataFrame:
    """How many calls of each service found no server, and how many of its spans no client."""
    sides = [pairs.filter(F.col(there) == UNKNOWN).select(F.col(here).alias("service_name"), F.lit(there).alias("missing")) for here, there in (("client", "server"), ("server", "client"))]
    return sides[0].unionByName(sides[1]).groupBy("service_name", "missing").agg(F.count("*").alias("spans"))


def signatures(logs: DataFrame, span: str = SPAN, lateness: str = LATENESS) -> DataFrame:
    """Lines and first appearance of each template in tumbling windows; lines that give orders are left out."""
    rows = _late(logs.filter(F.size(injection_categories(F.col("body"))) == 0), "timestamp", lateness)
    found = rows.groupBy(F.window("timestamp", span).alias("w"), "service_name", mask_log(F.col("body")).alias("template")).agg(F.count("*").alias("lines"), F.min("timestamp").alias("first_seen"))
    return found.select(F.col("w.start").alias("window_start"), "service_name", "template", "lines", "first_seen")
