"""Readers, normalisers and sinks over files that Spark first writes from the provided tables, and their DuckDB twins.

Each query exports a table in the raw form that a source has (JSON documents by folder, JSON lines, exports of range
results, traces and logs) to the shared folder and reads it back through the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelens.operators import governance
from quakelens.sources import normalise, readers, schemas, writers
from quakelens.sources import projections as P
from quakelens.sources.projections import Query, oracle
from quakelens.sources.staging import shared_path

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def by_folder(df: DataFrame, name: str, named: bool = True) -> str:
    """df as a JSON document for each row, each in the folder of its bundle; returns the root. named: whether documents bear their bundle's id."""
    root = shared_path(df.sparkSession, name)
    whole = df.withColumn("folder", F.col("bundle_id")).repartition("folder")
    (whole if named else whole.drop("bundle_id")).write.partitionBy("folder").json(root)
    return root


def _topology(s: SparkSession, d: str) -> DataFrame:
    # A bundle's edges are those between services, whatever the number of its calls.
    edges = P.fx_edges(s, d).groupBy("bundle_id").agg(F.collect_list(F.struct("client", "server", "requests_per_second", "failures_per_second", F.lit(9.0).alias("error_ratio"))).alias("edges"))
    found = readers.read_topology(s, by_folder(edges, "topology", named=False), "*.json")
    return found.select(F.substring_index("bundle_id", "=", -1).alias("bundle_id"), "client", "server", F.round("requests_per_second", 9).alias("requests_per_second"), "error_ratio")


add(
    "s04_topology", _topology,
    oracle("SELECT bundle_id, client, server, round(requests_per_second, 9) AS requests_per_second, round(failures_per_second / requests_per_second, 6) AS error_ratio FROM fx_edges", "fx_edges"),
)


def _alerts(s: SparkSession, d: str) -> DataFrame:
    """A delivery for each order (at most a few lines), an alert for each of its lines."""
    lines = P.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_suppkey"))).alias("lines"))
    alerts = F.transform("lines", lambda x: F.struct(
        F.when(x["l_returnflag"] == "R", "resolved").when(x["l_returnflag"] == "A", "firing").alias("status"),
        F.create_map(F.lit("alertname"), F.concat(F.lit("supp-"), (x["l_suppkey"] % 12).cast("string")), F.lit("order"), x["l_linenumber"].cast("string")).alias("labels"),
    ))
    orders = P.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("received_at"))
    path = shared_path(s, "deliveries")
    orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("received_at", F.struct(alerts.alias("alerts")).alias("payload")).write.json(path)
    return readers.read_alerts(s, path).select("received_at", "summary", "status", F.col("labels")["alertname"].alias("alertname"))


add(
    "s06_alert_deliveries", _alerts,
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'resolved' WHEN 'A' THEN 'firing' END AS status, 'supp-' || (l_suppkey % 12) AS alertname FROM lineitem),
 s AS (SELECT l_orderkey, count(*) || ' alert(s): ' || string_agg(alertname || '[' || coalesce(status, 'unknown') || ']', ', ' ORDER BY l_linenumber, l_returnflag, l_suppkey) AS summary FROM l GROUP BY 1)
SELECT o_orderdate AS received_at, coalesce(summary, '0 alert(s): ') AS summary, status, alertname FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN l ON l.l_orderkey = o_orderkey""",
)


def _library(s: SparkSession, d: str) -> DataFrame:
    counts = P.fx_metrics(s, d).groupBy("bundle_id").agg(F.count("*").alias("n"))
    manifests = P.fx_windows(s, d).join(counts, "bundle_id").select(
        "bundle_id", F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("window"), "alert_fired_at",
        F.array(F.struct(F.lit("metrics.parquet").alias("name"), F.col("n").alias("rows")), F.struct(F.lit("logs.parquet").alias("name"), F.lit(0).alias("rows"))).alias("files"),
    )
    found = readers.library_index(s, by_folder(manifests, "manifests"), "*.json")
    return found.select("bundle_id", "window_start", "window_end", "alert_fired_at", F.col("rows")["metrics.parquet"].alias("metric_rows"), F.col("rows")["logs.parquet"].alias("log_rows"))


add(
    "s07_library_index", _library,
    oracle("SELECT w.*, n AS metric_rows, 0::BIGINT AS log_rows FROM fx_windows w JOIN (SELECT bundle_id, count(*) AS n FROM fx_metrics GROUP BY 1) USING (bundle_id)", "fx_windows"),
)


def _labels(s: SparkSession, d: str) -> DataFrame:
    labels = P.fx_outcomes(s, d).select("bundle_id", F.concat(F.lit("run-"), "bundle_id").alias("run_id"), F.lit("train").alias("split"), F.col("truth").alias("target_service"))
    return readers.read_labels(s, by_folder(labels, "labels")).select("bundle_id", "run_id", "split", "target_service")


add("s08_labels", _labels, oracle("SELECT bundle_id, 'run-' || bundle_id AS run_id, 'train' AS split, truth AS target_service FROM fx_outcomes", "fx_outcomes"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Documents as JSON lines; those of one language are broken off before the end of the line."""
    line = F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    path = shared_path(s, "lines")
    P.table(s, d, "documents").select(F.when(F.col("lang") == "fr", F.regexp_replace(line, r"\}$", "")).otherwise(line).alias("value")).write.text(path)
    return readers.read_lines(s, path, "doc_id long, text string", strict=False).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


add("s09_tolerant_lines", _lines, "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents WHERE lang IS DISTINCT FROM 'fr'")


def _contract(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "contract")
    writers.write_table(P.fx_metrics(s, d).select(*schemas.METRICS.names), schemas.METRICS, path)
    return s.read.schema(schemas.METRICS).parquet(path)


add("s10_contract", _contract, oracle("SELECT timestamp, metric_name, service_name, labels_json, value FROM fx_metrics", "fx_metrics"))


def _range_results(s: SparkSession, d: str) -> DataFrame:
    """Samples of one service, type and hour as one range result; those of one type are not numbers."""
    seconds = (F.unix_micros("timestamp") / 1_000_000).cast("decimal(20, 6)").cast("string")
    text = F.when(F.col("metric_name") == "signup", "NaN").otherwise(F.col("value").cast("string"))
    results = P.fx_metrics(s, d).groupBy("metric_name", "service_name", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.collect_list(F.array(seconds, text)).alias("values")
    )
    metric = F.create_map(F.lit("service_name"), F.lit(""), F.lit("kind"), F.col("metric_name"), F.lit("client"), F.col("service_name"))
    path = shared_path(s, "ranges")
    results.select(metric.alias("metric"), "values").write.json(path)
    return normalise.metric_rows(s.read.schema(normalise.RANGE_RESULT).json(path), "calls")


add(
    "s11_range_results", _range_results,
    oracle("""SELECT timestamp, 'calls' AS metric_name, service_name, '{"client":"' || service_name || '","kind":"' || metric_name || '","service_name":""}' AS labels_json, value FROM fx_metrics WHERE metric_name <> 'signup' AND value IS NOT NULL""", "fx_metrics"),
)


def _span_exports(s: SparkSession, d: str) -> DataFrame:
    """Each trace (an order with its few lines) as one export, in which spans name their processes."""
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    identity = lambda c: F.concat(F.col("trace_id").cast("string"), F.lit("-"), F.col(c))
    status = F.col("status_code")
    span = F.struct(
        F.col("trace_id").cast("string").alias("traceID"), identity("span_id").alias("spanID"), F.col("span_name").alias("operationName"),
        F.when(F.col("parent_span_id").isNull(), F.array()).otherwise(F.array(F.struct(F.lit("FOLLOWS_FROM").alias("refType"), F.lit("x").alias("spanID")), F.struct(F.lit("CHILD_OF").alias("refType"), identity("parent_span_id").alias("spanID")))).alias("references"),
        F.unix_micros("start_time").alias("startTime"), F.round(F.col("duration_ms") * 1000).cast("long").alias("duration"),
        F.when(status == "ERROR", F.array(tag("error", F.lit("true")))).otherwise(F.array(tag("otel.status_code", F.lit("ok")), tag("span.kind", F.lit("server")))).alias("tags"), F.col("service_name").alias("processID"),
    )
    traces = P.fx_spans(s, d).groupBy("trace_id").agg(
        F.collect_list(span).alias("spans"), F.map_from_entries(F.collect_set(F.struct(F.col("service_name").alias("k"), F.struct(F.concat(F.lit("the "), "service_name").alias("serviceName")).alias("v")))).alias("processes")
    )
    path = shared_path(s, "traces")
    traces.select(F.array(F.struct("spans", "processes")).alias("data")).write.option("compression", "gzip").json(path)
    found = normalise.span_rows(s.read.schema(normalise.SPAN_EXPORT).json(path))
    return found.select("trace_id", "span_id", "parent_span_id", "service_name", "span_name", "span_kind", "start_time", F.round("duration_ms", 3).alias("duration_ms"), "status_code")


add(
    "s12_span_exports", _span_exports,
    oracle("SELECT CAST(trace_id AS VARCHAR) AS trace_id, trace_id || '-' || span_id AS span_id, trace_id || '-' || parent_span_id AS parent_span_id, 'the ' || service_name AS service_name, span_name, CASE WHEN status_code = 'ERROR' THEN 'INTERNAL' ELSE 'SERVER' END AS span_kind, start_time, round(CAST(round(duration_ms * 1000) AS BIGINT) / 1000.0::DOUBLE, 3) AS duration_ms, CASE WHEN status_code = 'ERROR' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_OK' END AS status_code FROM fx_spans", "fx_spans"),
)


def _log_exports(s: SparkSession, d: str) -> DataFrame:
    """Lines of all documents as exported logs; a severity of one kind is missing, one service is the collector's own."""
    logs = P.fx_logs(s, d)
    own = F.when(F.col("service_name") == "src7", normalise.OWN_COLLECTOR).otherwise(F.col("service_name"))
    path = shared_path(s, "logs")
    logs.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'789'").alias("timestamp"), own.alias("service"), F.when(F.col("severity") != "INFO", F.lower("severity")).alias("severity"), "body",
        F.col("doc_id").cast("string").alias("trace_id"), F.create_map(F.lit("z"), F.lit("1"), F.lit("line"), F.col("line").cast("string")).alias("attributes"),
    ).write.json(path)
    return normalise.log_rows(s.read.schema(normalise.LOG_EXPORT).json(path))


add(
    "s13_log_exports", _log_exports,
    oracle("""SELECT timestamp, service_name, CASE severity WHEN 'INFO' THEN 'UNSPECIFIED' ELSE severity END AS severity, body, CAST(doc_id AS VARCHAR) AS trace_id, '{"line":"' || line || '","z":"1"}' AS attributes_json FROM fx_logs WHERE body <> '' AND service_name <> '' AND service_name <> 'src7'""", "fx_logs"),
)


def _feedback(s: SparkSession, d: str) -> DataFrame:
    """Two opinions on each document, the second appended after the first."""
    marks = P.table(s, d, "labels")
    path = shared_path(s, "feedback")
    for reviewer, mark in (("first", "quality"), ("second", "toxic")):
        writers.append_feedback(marks.select("doc_id", F.lit(reviewer).alias("reviewer"), F.col(mark).cast("long").alias("mark")), path)
    return readers.read_lines(s, path, "doc_id long, reviewer string, mark long")


add("s15_feedback", _feedback, "SELECT doc_id, 'first' AS reviewer, CAST(quality AS BIGINT) AS mark FROM labels UNION ALL SELECT doc_id, 'second', CAST(toxic AS BIGINT) FROM labels")


def _bundles(s: SparkSession, d: str) -> DataFrame:
    """Passages in a folder for each of five bundles, with manifests that are right, stale, short, too long, and one beside an answer."""
    root = shared_path(s, "bundles")
    P.table(s, d, "benchmark").withColumn("folder", F.col("item_id") % 5).repartition("folder").write.partitionBy("folder").json(root)
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/folder=4/label.json")
    path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(path).close()
    files = readers.bundle_files(s, root)
    turned = F.when(F.col("bundle_id") == "folder=1", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256")
    listed = files.filter("name <> 'label.json' and bundle_id <> 'folder=2'").select("bundle_id", "name", turned)
    gone = files.filter("bundle_id = 'folder=3'").select("bundle_id", F.lit("gone.json").alias("name"), F.lit("0").alias("sha256")).distinct()
    none = files.filter("bundle_id = 'folder=2'").select("bundle_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("sha256")).distinct()
    found = governance.bundle_findings(files, listed.unionByName(gone).unionByName(none), [], ["label.json"])
    return found.groupBy("bundle_id", "finding").agg(F.count("*").alias("files"))


add("v10_files", _bundles, """SELECT DISTINCT 'folder=' || (item_id % 5) AS bundle_id, finding, 1::BIGINT AS files FROM benchmark
 JOIN (VALUES (1, 'changed'), (2, 'unlisted'), (3, 'missing'), (4, 'unlisted'), (4, 'forbidden')) v(b, finding) ON b = item_id % 5""")  # fmt: skip
