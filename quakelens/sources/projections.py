"""Telemetry-shaped projections of the provided tables, and their DuckDB twins.

Each projection is a function of (spark, sf_dir); SQL holds the same definition as a view of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_SECONDS = 518_400
DIRECTIONS = [("click", "EITHER"), ("error", "UP"), ("purchase", "DOWN"), ("signup", "UP"), ("view", "UP")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_metrics(spark: SparkSession, d: str) -> DataFrame:
    origin = 1_704_067_200
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - origin
    return table(spark, d, "events").select(
        F.concat(F.lit("inc_"), F.floor(seconds / BLOCK_SECONDS).cast("string")).alias("bundle_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("metric_name"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service_name"),
        F.col("props").alias("labels_json"),
        F.when(F.col("event_type") == "error", "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK").alias("status_code"),
        F.col("value"),
    )


def fx_error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly errors by bundle with events and service, zero where there are none."""
    m = fx_metrics(spark, d)
    hour = F.date_trunc("hour", "timestamp")
    seen = m.filter("metric_name = 'error'").groupBy("bundle_id", "service_name", hour.alias("timestamp")).agg(F.count("*").alias("n"))
    block = F.substring_index("bundle_id", "_", -1).cast("long")
    blocks = m.select("bundle_id").distinct()
    start = block * (BLOCK_SECONDS // 3600)
    hours = blocks.select("bundle_id", F.explode(F.sequence(start, start + BLOCK_SECONDS // 3600 - 1)).alias("id")).select("bundle_id", F.timestamp_seconds(F.col("id") * 3600 + 1_704_067_200).alias("timestamp"))
    grid = hours.crossJoin(F.broadcast(spark.range(8).select(F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("service_name"))))
    keys = ["bundle_id", "service_name", "timestamp"]
    return grid.join(seen, keys, "left").select(*keys, F.lit("error_count").alias("metric_name"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def fx_windows(spark: SparkSession, d: str) -> DataFrame:
    """A manifest row for each block with events; blocks of even number have an alert in the middle."""
    start = F.col("id") * BLOCK_SECONDS + 1_704_067_200
    return fx_metrics(spark, d).select("bundle_id").distinct().select(F.substring_index("bundle_id", "_", -1).cast("long").alias("id")).select(
        F.concat(F.lit("inc_"), F.col("id").cast("string")).alias("bundle_id"),
        F.timestamp_seconds(start).alias("window_start"),
        F.timestamp_seconds(start + BLOCK_SECONDS).alias("window_end"),
        F.when(F.col("id") % 2 == 0, F.timestamp_seconds(start + BLOCK_SECONDS // 2)).alias("alert_fired_at"),
    )


def fx_directions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(DIRECTIONS, "metric_name string, direction string")


def fx_spans(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """`dealt`: orders are dealt by trace as the lines are for their numbers, so that what follows within traces needs no shuffle."""
    orders = table(spark, d, "orders")
    roots = (orders.repartition("o_orderkey") if dealt else orders).select(
        F.col("o_orderkey").alias("trace_id"), F.lit("o").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.concat(F.lit("prio-"), "o_orderpriority").alias("service_name"),
        F.col("o_orderstatus").alias("span_name"), F.col("o_orderdate").cast("timestamp").alias("start_time"), (F.col("o_totalprice") / 1000).alias("duration_ms"), F.lit("OK").alias("status_code"),
    )
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    parent = (
        F.when((F.col("l_returnflag") == "A") & (F.col("rn") % 5 == 0), F.lit("x")).when(F.col("rn") == 1, F.lit("o")).otherwise(F.concat(F.lit("l"), F.floor(F.col("rn") / 2).cast("string")))
    )
    lines = table(spark, d, "lineitem").withColumn("rn", rn).select(
        F.col("l_orderkey").alias("trace_id"), F.concat(F.lit("l"), F.col("rn").cast("string")).alias("span_id"), parent.alias("parent_span_id"),
        F.concat(F.lit("supp-"), (F.col("l_suppkey") % 12).cast("string")).alias("service_name"), F.concat(F.lit("op-"), (F.col("l_partkey") % 5).cast("string")).alias("span_name"),
        F.col("l_shipdate").cast("timestamp").alias("start_time"), (F.col("l_extendedprice") / 1000).alias("duration_ms"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status_code"),
    )
    return roots.unionByName(lines)


def fx_edges(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    client, server = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("client")), nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("server"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("bundle"))
    calls = (
        lines.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .filter("c_nationkey <> s_nationkey")
        .groupBy("bundle", "c_nationkey", "s_nationkey")
        .agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("f"))
    )
    return calls.join(client, "c_nationkey").join(server, "s_nationkey").select(
        F.col("bundle").cast("string").alias("bundle_id"), "client", "server", (F.col("n") / 86400.0).alias("requests_per_second"), (F.col("f") / 86400.0).alias("failures_per_second")
    )


def fx_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """A suspicion for each node, from its suppliers' balances."""
    scores = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(F.greatest(F.avg("s_acctbal"), F.lit(0.0)) / 1000, 6).alias("anomaly"))
    return table(spark, d, "nation").join(scores, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("service"), F.coalesce("anomaly", F.lit(0.0)).alias("anomaly"))


def fx_logs(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "text", "source").join(marks, "doc_id", "left")
    severity = F.when(F.col("toxic") == 1, "FATAL").when(F.col("quality") == 0, "ERROR").when(F.col("doc_id") % 5 == 0, "WARN").otherwise("INFO")
    return docs.select("doc_id", F.col("source").alias("service_name"), severity.alias("severity"), F.posexplode(F.split("text", "\n")).alias("line", "body")).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60 + F.col("line")).alias("timestamp"), "service_name", "severity", "body", "doc_id", F.col("line").cast("long").alias("line")
    )


def fx_changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("change_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("svc-"), (F.col("o_custkey") % 8).cast("string")).alias("service"), F.col("o_orderpriority").alias("detail")
    )


def split_fraction(key: Column) -> Column:
    """A number in [0, 1) from a key, from the first 13 hex digits of a salted digest (exact in a double)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("split:"), key), 256), 1, 13), 16, 10).cast("double") / float(2**52)


def fx_memory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("incident_id"),
        F.col("text").alias("symptom_summary"),
        F.array_distinct(F.array(F.concat(F.lit("svc-"), (F.col("doc_id") % 8).cast("string")), F.concat(F.lit("svc-"), (F.col("doc_id") % 3).cast("string")))).alias("services_involved"),
        F.when(split_fraction(F.col("doc_id").cast("string")) < 0.5, "train").otherwise("held_out").alias("split"),
    )


def fx_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("svc-"), (F.col("item_id") % 8).cast("string")).alias("service"))


def fx_runbooks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("runbook_id"), F.concat(F.lit("runbook "), F.col("lang")).alias("title"), F.array("source").alias("covers"), F.col("text").alias("body"))


def fx_forecast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", (F.least("n_chars", F.lit(4000)) / 4000.0).alias("confidence"), (F.col("quality") == 1).alias("outcome"), (F.col("n_chars") >= 200).alias("answered"),
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("configuration"), F.floor(F.col("doc_id") / 2).alias("task"), (F.col("doc_id") % 2).alias("trial"), "source", "n_chars",
    )


def fx_raters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("first"), (F.col("n_chars") >= 800).alias("second"))


def fx_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Ranked candidates by requests for each bundle, with the node of most failures as truth."""
    load = fx_edges(spark, d).groupBy("bundle_id", F.col("server").alias("service")).agg(F.sum("requests_per_second").alias("r"), F.sum("failures_per_second").alias("f"))
    by = Window.partitionBy("bundle_id")
    ranked = load.withColumns({"place": F.row_number().over(by.orderBy(F.desc(F.round("r", 9)), "service")), "worst": F.row_number().over(by.orderBy(F.desc(F.round("f", 9)), "service"))})
    return ranked.groupBy("bundle_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "service")))), lambda x: x["service"]).alias("ranked_candidates"), F.max(F.when(F.col("worst") == 1, F.col("service"))).alias("truth")
    )


def fx_canaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("canary"))


def fx_calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("round"), F.col("role").alias("call"), F.floor(F.length("text") / 4).alias("tokens"))


SQL: dict[str, str] = {
    "fx_metrics": "SELECT 'inc_' || CAST(floor((floor(epoch_us(ts) / 1000000.0) - 1704067200) / 518400.0) AS BIGINT) AS bundle_id, ts AS timestamp, event_type AS metric_name, 'svc-' || (user_id % 8) AS service_name, props AS labels_json, CASE WHEN event_type = 'error' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_OK' END AS status_code, value FROM events",
    "fx_windows": "SELECT 'inc_' || i AS bundle_id, TIMESTAMP '2024-01-01' + to_seconds(i * 518400) AS window_start, TIMESTAMP '2024-01-01' + to_seconds((i + 1) * 518400) AS window_end, CASE WHEN i % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_seconds(i * 518400 + 259200) END AS alert_fired_at FROM (SELECT DISTINCT CAST(substr(bundle_id, 5) AS BIGINT) AS i FROM fx_metrics)",
    "fx_error_counts": "SELECT g.bundle_id, g.service_name, g.timestamp, 'error_count' AS metric_name, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT bundle_id, TIMESTAMP '2024-01-01' + to_seconds((i * 144 + h) * 3600) AS timestamp, 'svc-' || s AS service_name FROM (SELECT DISTINCT bundle_id, CAST(substr(bundle_id, 5) AS BIGINT) AS i FROM fx_metrics), range(144) a(h), range(8) b(s)) g LEFT JOIN (SELECT bundle_id, service_name, date_trunc('hour', timestamp) AS timestamp, count(*) AS n FROM fx_metrics WHERE metric_name = 'error' GROUP BY ALL) USING (bundle_id, service_name, timestamp)",
    "fx_directions": "SELECT * FROM (VALUES ('click', 'EITHER'), ('error', 'UP'), ('purchase', 'DOWN'), ('signup', 'UP'), ('view', 'UP')) t(metric_name, direction)",
    "fx_spans": "SELECT o_orderkey AS trace_id, 'o' AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'prio-' || o_orderpriority AS service_name, o_orderstatus AS span_name, o_orderdate AS start_time, o_totalprice / 1000 AS duration_ms, 'OK' AS status_code FROM orders UNION ALL SELECT l_orderkey, 'l' || rn, CASE WHEN l_returnflag = 'A' AND rn % 5 = 0 THEN 'x' WHEN rn = 1 THEN 'o' ELSE 'l' || (rn // 2) END, 'supp-' || (l_suppkey % 12), 'op-' || (l_partkey % 5), l_shipdate, l_extendedprice / 1000, CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'OK' END FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem)",
    "fx_edges": "SELECT CAST(year(l_shipdate) AS VARCHAR) AS bundle_id, c.n_name AS client, s.n_name AS server, count(*) / 86400.0::DOUBLE AS requests_per_second, count(*) FILTER (l_returnflag = 'R') / 86400.0::DOUBLE AS failures_per_second FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey WHERE c_nationkey <> s_nationkey GROUP BY ALL",
    "fx_anomaly": "SELECT n_name AS service, coalesce(a, 0.0::DOUBLE) AS anomaly FROM nation LEFT JOIN (SELECT s_nationkey, round(greatest(avg(s_acctbal), 0.0::DOUBLE) / 1000, 6) AS a FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey",
    "fx_logs": "SELECT TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60 + line) AS timestamp, service_name, severity, body, doc_id, line FROM (SELECT doc_id, source AS service_name, CASE WHEN toxic = 1 THEN 'FATAL' WHEN quality = 0 THEN 'ERROR' WHEN doc_id % 5 = 0 THEN 'WARN' ELSE 'INFO' END AS severity, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents LEFT JOIN labels USING (doc_id))",
    "fx_changes": "SELECT o_orderkey AS change_id, o_orderdate AS at, o_orderstatus AS kind, 'svc-' || (o_custkey % 8) AS service, o_orderpriority AS detail FROM orders",
    "fx_memory": "SELECT doc_id AS incident_id, text AS symptom_summary, list_distinct(['svc-' || (doc_id % 8), 'svc-' || (doc_id % 3)]) AS services_involved, CASE WHEN ('0x' || substr(sha256('split:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.5 THEN 'train' ELSE 'held_out' END AS split FROM documents",
    "fx_queries": "SELECT item_id AS query_id, text, 'svc-' || (item_id % 8) AS service FROM benchmark",
    "fx_runbooks": "SELECT doc_id AS runbook_id, 'runbook ' || lang AS title, [source] AS covers, text AS body FROM documents",
    "fx_forecast": "SELECT doc_id, least(n_chars, 4000) / 4000.0::DOUBLE AS confidence, quality = 1 AS outcome, n_chars >= 200 AS answered, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS configuration, doc_id // 2 AS task, doc_id % 2 AS trial, source, n_chars FROM documents JOIN labels USING (doc_id)",
    "fx_raters": "SELECT doc_id, quality = 1 AS first, n_chars >= 800 AS second FROM documents JOIN labels USING (doc_id)",
    "fx_outcomes": "SELECT bundle_id, list(service ORDER BY place) FILTER (place <= 5) AS ranked_candidates, max(service) FILTER (worst = 1) AS truth FROM (SELECT bundle_id, service, row_number() OVER (PARTITION BY bundle_id ORDER BY round(r, 9) DESC, service) AS place, row_number() OVER (PARTITION BY bundle_id ORDER BY round(f, 9) DESC, service) AS worst FROM (SELECT bundle_id, server AS service, sum(requests_per_second) AS r, sum(failures_per_second) AS f FROM fx_edges GROUP BY ALL)) GROUP BY bundle_id",
    "fx_canaries": "SELECT item_id, text AS canary FROM benchmark",
    "fx_calls": "SELECT conv_id, turn AS round, role AS call, length(text) // 4 AS tokens FROM conversations",
}
_NEEDS = {"fx_windows": ["fx_metrics"], "fx_error_counts": ["fx_metrics"], "fx_outcomes": ["fx_edges"]}


def oracle(body: str, *views: str, **more: str) -> str:
    """DuckDB SQL with the named views (and further ones) in front of a query."""
    needed: list[str] = []
    for v in views:
        needed += [x for x in (*_NEEDS.get(v, []), v) if x not in needed]
    parts = [f"{v} AS ({SQL[v]})" for v in needed] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


Query = Callable[[SparkSession, str], DataFrame]
