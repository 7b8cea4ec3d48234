"""The streaming operators over the provided tables: as batch twins of the same functions, or as streams read to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelens.operators import topology
from quakelens.sources import projections as P
from quakelens.sources import readers
from quakelens.sources.projections import Query, oracle
from quakelens.sources.staging import moved, shared_path
from quakelens.streaming import alerts, rollups, watch
from quakelens.streaming.totals import Totals

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


add("r01_red", lambda s, d: rollups.red(P.fx_spans(s, d), "1 day"), oracle("SELECT date_trunc('day', start_time) AS window_start, service_name, status_code, count(*) AS calls FROM fx_spans GROUP BY ALL", "fx_spans"))
SLIDES = "SELECT {k}, status_code, duration_ms, unnest([date_trunc('day', start_time), date_trunc('day', start_time) - INTERVAL 1 DAY, date_trunc('day', start_time) - INTERVAL 2 DAY]) AS w FROM {t}"
add("r02_error_ratio", lambda s, d: rollups.error_ratios(P.fx_spans(s, d), "3 days", "1 day"), oracle("SELECT w AS window_start, service_name, count(*) AS calls, round(count(*) FILTER (status_code = 'ERROR') / count(*), 6) AS ratio, count(*) FILTER (status_code = 'ERROR') / count(*) > 0.05 AS firing FROM s GROUP BY ALL", "fx_spans", s=SLIDES.format(k="service_name", t="fx_spans")))
add("r03_slow", lambda s, d: rollups.slow_services(P.fx_spans(s, d), "3 days", "1 day", limit=90.0), oracle("SELECT w AS window_start, service_name, quantile_disc(duration_ms, 0.95) AS p95_ms, quantile_disc(duration_ms, 0.95) > 90 AS firing FROM s GROUP BY ALL", "fx_spans", s=SLIDES.format(k="service_name", t="fx_spans")))
_EDGES = "SELECT p.service_name AS client, c.service_name AS server, c.start_time, c.status_code, c.duration_ms FROM fx_spans c JOIN fx_spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service_name <> c.service_name"
add("r04_edge_ratio", lambda s, d: rollups.error_ratios(topology.span_edges(P.fx_spans(s, d)).withColumn("status_code", F.when(F.col("failed"), "ERROR").otherwise("OK")), "3 days", "1 day", limit=rollups.EDGE_LIMIT, keys=("client", "server")),
    oracle("SELECT w AS window_start, client, server, count(*) AS calls, round(count(*) FILTER (status_code = 'ERROR') / count(*), 6) AS ratio, count(*) FILTER (status_code = 'ERROR') / count(*) > 0.1 AS firing FROM s GROUP BY ALL", "fx_spans", e=_EDGES, s=SLIDES.format(k="client, server", t="e")))
add("r05_pairs", lambda s, d: rollups.paired(P.fx_spans(s, d), P.fx_spans(s, d), "40 days").select("trace_id", "client", "server", "duration_ms"),
    oracle("SELECT c.trace_id, p.service_name AS client, c.service_name AS server, c.duration_ms FROM fx_spans c JOIN fx_spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.start_time BETWEEN p.start_time - INTERVAL 40 DAYS AND p.start_time + INTERVAL 40 DAYS", "fx_spans"))
_SAMPLES = "SELECT 'errors' AS rule, service_name, timestamp AS at, value > 20 AS firing FROM fx_metrics WHERE metric_name IN ('error', 'view')"


def _samples(s, d):
    return P.fx_metrics(s, d).filter("metric_name in ('error', 'view')").select(F.lit("errors").alias("rule"), "service_name", F.col("timestamp").alias("at"), (F.col("value") > 20).alias("firing"))


HELD = "SELECT rule, service_name, min(t) AS fired_at FROM (SELECT *, min(t) OVER (PARTITION BY service_name, run) AS since FROM (SELECT rule, service_name, x.\"at\" AS t, firing, sum((NOT firing)::INT) OVER (PARTITION BY service_name ORDER BY x.\"at\") AS run FROM x) WHERE firing) WHERE epoch_us(t) - epoch_us(since) >= 7200000000 GROUP BY rule, service_name, run"
add("r06_hold", lambda s, d: alerts.held(_samples(s, d), 7200), oracle(HELD, "fx_metrics", x=_SAMPLES.replace(" AS at", ' AS "at"')))
add("r07_groups", lambda s, d: alerts.grouped(alerts.held(_samples(s, d), 7200), "1 day"),
    oracle("SELECT rule, service_name, min(fired_at) AS first_at, max(fired_at) + INTERVAL 1 DAY AS closed_at, count(*) AS alerts FROM (SELECT *, sum(n) OVER (PARTITION BY service_name ORDER BY fired_at) AS g FROM (SELECT *, CASE WHEN fired_at >= lag(fired_at) OVER (PARTITION BY service_name ORDER BY fired_at) + INTERVAL 1 DAY THEN 1 ELSE 0 END AS n FROM held)) GROUP BY rule, service_name, g", "fx_metrics", x=_SAMPLES.replace(" AS at", ' AS "at"'), held=HELD))
add("r12_signatures", lambda s, d: rollups.signatures(P.fx_logs(s, d), "1 day").groupBy("window_start", "service_name").agg(F.sum("lines").alias("lines"), F.min("first_seen").alias("first_seen")), oracle("SELECT date_trunc('day', timestamp) AS window_start, service_name, count(*) AS lines, min(timestamp) AS first_seen FROM fx_logs GROUP BY ALL", "fx_logs"))


# Queries below run as streams: a table is written to the shared folder, read as a stream to its end, and the sink's files
# are the result. What the watermark hasn't passed by then is not out yet, in the twins as well.
def _source(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _to_end(stream: DataFrame, name: str) -> DataFrame:
    path = shared_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def watermark(column: str, table: str, seconds: int) -> str:
    """SQL for a stream's last watermark in microseconds; Spark keeps it in whole milliseconds."""
    return f"(SELECT epoch_us(max({column})) // 1000 * 1000 - {seconds}000000 FROM {table})"


# Every second line's order is missing among the calls, so that lone spans are on both sides.
_CALLS, _SERVED = "(span_id <> 'o' OR trace_id % 2 = 0)", "parent_span_id IS NOT NULL"


#: Spans that one run takes in.
SLICE_ROWS = 30_000_000


def _unmatched(s: SparkSession, d: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Calling and called spans as two streams: pairs, and lone spans once the watermark has passed their time to live.

    Spans are written once, dealt to slices of time of whole hours. The streams find one slice after another, each in a run
    of its own from the same checkpoint, so that a run holds a slice and what waits, not the table; the watermark never
    passes what is still to come.
    """
    spans = P.fx_spans(s, d).drop("span_name")
    hour = F.expr("unix_micros(start_time) div 3600000000")
    hours = spans.filter("start_time is not null").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    slices = hours.withColumn("slice", F.floor((F.sum("n").over(Window.orderBy("hour")) - 1) / slice_rows))
    starts = sorted(r.start for r in slices.groupBy("slice").agg(F.min("hour").alias("start")).collect())
    dealt, path, found = (shared_path(s, name) for name in ("slices", "spans", "pairs"))
    number = sum((F.coalesce(hour >= start, F.lit(False)).cast("int") for start in starts[1:]), F.lit(0))
    spans.withColumn("slice", number).write.partitionBy("slice").parquet(dealt)
    for i in range(max(len(starts), 1)):
        if not moved(s, f"{dealt}/slice={i}", f"{path}/{i}"):
            spans.limit(0).write.parquet(f"{path}/{i}")
        calls, served = (s.readStream.schema(spans.schema).parquet(f"{path}/*").filter(kind) for kind in (_CALLS, _SERVED))
        rollups.paired_in_batches(calls, served, found, "40 days").option("checkpointLocation", f"{found}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    columns = "trace_id long, client string, server string, start_time timestamp, duration_ms double, status_code string"
    return s.read.schema(columns).parquet(f"{found}/pairs/batch=*")


add("r05_unmatched", _unmatched,
    oracle(f"""SELECT a.trace_id, a.service_name AS client, b.service_name AS server, b.start_time, b.duration_ms, b.status_code FROM a JOIN b ON a.trace_id = b.trace_id AND a.span_id = b.parent_span_id
 WHERE b.start_time BETWEEN a.start_time - INTERVAL 40 DAYS AND a.start_time + INTERVAL 40 DAYS
 UNION ALL SELECT a.trace_id, a.service_name, 'unknown', a.start_time, NULL, NULL FROM a, w WHERE epoch_us(a.start_time) + 40 * 86400000000 < w
  AND NOT EXISTS (SELECT 1 FROM b WHERE a.trace_id = b.trace_id AND a.span_id = b.parent_span_id AND b.start_time BETWEEN a.start_time - INTERVAL 40 DAYS AND a.start_time + INTERVAL 40 DAYS)
 UNION ALL SELECT b.trace_id, 'unknown', b.service_name, b.start_time, b.duration_ms, b.status_code FROM b, w WHERE epoch_us(b.start_time) + 40 * 86400000000 < w
  AND NOT EXISTS (SELECT 1 FROM a WHERE a.trace_id = b.trace_id AND a.span_id = b.parent_span_id AND b.start_time BETWEEN a.start_time - INTERVAL 40 DAYS AND a.start_time + INTERVAL 40 DAYS)""",
    "fx_spans", a=f"SELECT * FROM fx_spans WHERE {_CALLS}", b=f"SELECT * FROM fx_spans WHERE {_SERVED}", w=f"SELECT least({watermark('start_time', 'a', 30)}, {watermark('start_time', 'b', 30)}) AS w"))


CHANGES = """SELECT service_name, f, (SELECT min(b.t) FROM runs b WHERE b.service_name = h.service_name AND b.run = h.run + 1) AS r FROM (
 SELECT service_name, run, min(t) AS f FROM (SELECT *, min(t) OVER (PARTITION BY service_name, run) AS since FROM runs WHERE firing) WHERE epoch_us(t) - epoch_us(since) >= 7200000000 GROUP BY ALL) h"""
RUNS = 'SELECT service_name, x."at" AS t, firing, sum((NOT firing)::INT) OVER (PARTITION BY service_name ORDER BY x."at" ROWS UNBOUNDED PRECEDING) AS run FROM x'
_CHANGED = {"x": _SAMPLES.replace(" AS at", ' AS "at"'), "runs": RUNS, "c": CHANGES}

add("r06_changes", lambda s, d: _to_end(alerts.changes_stream(_source(_samples(s, d), "samples"), 7200), "changes"),
    oracle(f"SELECT 'errors' AS rule, service_name, f AS \"at\", 'firing' AS status FROM c WHERE epoch_us(f) <= {watermark('x.\"at\"', 'x', 30)} UNION ALL SELECT 'errors', service_name, r, 'resolved' FROM c WHERE epoch_us(r) <= {watermark('x.\"at\"', 'x', 30)}", "fx_metrics", **_CHANGED))
# The samples' hold keeps an alert's resolution and its next firing hours apart, so that each has a group of its own.
add("r07_deliveries", lambda s, d: _to_end(alerts.notifications(_source(alerts.changes(_samples(s, d), 7200), "changes")), "deliveries"),
    oracle(f"""SELECT 'errors' AS rule, service_name, make_timestamp(sent) AS sent_at, status FROM (
 SELECT service_name, 'firing' AS status, unnest(generate_series(epoch_us(f) + 10000000, least(epoch_us(r) - 1, w), 3600000000)) AS sent FROM c, w
 UNION ALL SELECT service_name, 'resolved', epoch_us(f) + 10000000 + 30000000 * CAST(ceil((epoch_us(r) - epoch_us(f) - 10000000) / 30000000.0::DOUBLE) AS BIGINT) FROM c WHERE epoch_us(r) > epoch_us(f) + 10000000), w WHERE sent <= w""",
    "fx_metrics", **_CHANGED, w="SELECT epoch_us(max(greatest(f, r))) // 1000 * 1000 - 30000000 AS w FROM c"))


def _delivered(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "lines")
    alerts.deliver(_source(alerts.held(_samples(s, d), 7200), "fired"), path, f"{path}-checkpoint").awaitTermination()
    found = readers.read_lines(s, path, "rule string, service_name string, fired_at timestamp, received_at timestamp")
    return found.select("rule", "service_name", "fired_at", (F.col("received_at") > F.col("fired_at")).alias("after"))


add("r08_delivered", _delivered, oracle("SELECT rule, service_name, fired_at, true AS after FROM held", "fx_metrics", x=_SAMPLES.replace(" AS at", ' AS "at"'), held=HELD))


def _readings(s: SparkSession, d: str) -> DataFrame:
    """A watch for each customer from the first order on; orders' prices are its readings, those of open orders are missing."""
    at = F.col("o_orderdate").cast("timestamp")
    price = F.min(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    read = P.table(s, d, "orders").groupBy(F.col("o_custkey").alias("watch"), at.alias("at")).agg(price.alias("value"))
    first = P.table(s, d, "orders").groupBy(F.col("o_custkey").alias("watch")).agg(F.min(at).alias("acted_at"))
    return read.join(first, "watch").withColumn("baseline", F.when(F.col("watch") % 9 != 0, F.lit(100_000.0)))


add("r09_recovery", lambda s, d: _to_end(watch.recovery_watch(_source(_readings(s, d), "readings"), 2, 40_000_000), "recovery"),
    f"""WITH x AS (SELECT o_custkey AS watch, o_orderdate AS t, min(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS value FROM orders GROUP BY ALL),
 a AS (SELECT watch, min(t) AS acted, CASE WHEN watch % 9 <> 0 THEN 100000 END AS baseline FROM x GROUP BY 1), w AS (SELECT {watermark('t', 'x', 30)} AS w),
 r AS (SELECT watch, t, (epoch_us(t) - epoch_us(acted)) / 1000000.0::DOUBLE AS since, CASE WHEN value <= baseline * 1.25::DOUBLE THEN 1 ELSE 0 END AS inside FROM x JOIN a USING (watch) WHERE value IS NOT NULL AND baseline IS NOT NULL AND epoch_us(t) - epoch_us(acted) <= 40000000000000),
 h AS (SELECT *, sum(inside) OVER (PARTITION BY watch ORDER BY t ROWS 1 PRECEDING) AS held FROM r),
 f AS (SELECT watch, count(*) AS readings, min(since) FILTER (held = 2) AS after, min(t) FILTER (held = 2) AS at2 FROM h GROUP BY 1),
 j AS (SELECT a.*, readings, CASE WHEN epoch_us(at2) <= w THEN after END AS after, epoch_us(acted) + 40000000000000 < w AS closed FROM a LEFT JOIN f USING (watch), w)
SELECT CAST(watch AS VARCHAR) AS watch, CASE WHEN after IS NOT NULL THEN 'recovered' WHEN readings IS NULL THEN 'unknown' ELSE 'not_recovered' END AS status, after AS after_seconds FROM j WHERE after IS NOT NULL OR closed""")  # fmt: skip


def _medians(s: SparkSession, d: str) -> DataFrame:
    return P.fx_metrics(s, d).groupBy("bundle_id", "service_name", "metric_name").agg(F.median("value").alias("median"), F.lit(8.0).alias("scale"))


add("r10_first_crossings", lambda s, d: _to_end(watch.first_crossings(_source(P.fx_metrics(s, d), "facts"), _medians(s, d)), "onsets"),
    oracle(f"SELECT bundle_id, service_name, min(timestamp) AS onset_at FROM fx_metrics JOIN b USING (bundle_id, service_name, metric_name) WHERE (value - m) / 8.0::DOUBLE >= 3 GROUP BY ALL HAVING epoch_us(min(timestamp)) <= {watermark('timestamp', 'fx_metrics', 30)}", "fx_metrics", b="SELECT bundle_id, service_name, metric_name, median(value) AS m FROM fx_metrics GROUP BY ALL"))
add("r11_silences", lambda s, d: _to_end(watch.silences(_source(P.fx_metrics(s, d), "facts")), "silences"),
    oracle(f"SELECT bundle_id, max(timestamp) AS silent_since FROM fx_metrics GROUP BY 1 HAVING epoch_us(max(timestamp)) + 120000000 < {watermark('timestamp', 'fx_metrics', 30)}", "fx_metrics"))


def _late(s: SparkSession, d: str) -> DataFrame:
    """Events of the second half of the month come first, those of the first half later; ten days late is too late."""
    events = P.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    path = shared_path(s, "events")
    late = 0
    with Totals(s) as totals:
        for part in ("at >= timestamp'2024-01-20'", "at < timestamp'2024-01-20'"):
            events.filter(part).write.mode("append").parquet(path)
            stream = s.readStream.schema(events.schema).parquet(path).withWatermark("at", "10 days").dropDuplicatesWithinWatermark(["event_id"])
            query = stream.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            late += totals.late_rows(query)
    return s.read.schema(events.schema).parquet(f"{path}-out").agg(F.count("*").alias("kept")).withColumn("late", F.lit(late).cast("long"))


add("r13_late_rows", _late,
    f"WITH w AS (SELECT {watermark('ts', 'events', 10 * 86_400)} AS w) SELECT count(*) - count(*) FILTER (late) AS kept, count(*) FILTER (late) AS late FROM (SELECT ts < TIMESTAMP '2024-01-20' AND epoch_us(ts) <= w AS late FROM events, w)")
