"""Queries over metric samples: windows, scores, onsets, gaps, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.operators import anomaly, continuity, governance, grading, lookups
from quakelens.operators.windows import choose_windows, tagged
from quakelens.sources import projections as P
from quakelens.sources.projections import Query, oracle
from quakelens.sources.schemas import outside_vocabulary

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WINDOWS = """SELECT bundle_id, window_start AS baseline_start, greatest(a - to_seconds(30), window_start) AS baseline_end, a AS incident_start, window_end AS incident_end, anchored FROM (
 SELECT *, CASE WHEN anchored THEN alert_fired_at ELSE window_start + to_microseconds(CAST(round((epoch_us(window_end) - epoch_us(window_start)) * 0.3333333333333333::DOUBLE) AS BIGINT)) END AS a FROM (
  SELECT *, coalesce(alert_fired_at IS NOT NULL AND window_start + to_seconds(60) < alert_fired_at AND alert_fired_at < window_end, false) AS anchored FROM fx_windows))"""
TAGGED = "SELECT m.*, m.timestamp BETWEEN w.baseline_start AND w.baseline_end AS b, m.timestamp BETWEEN w.incident_start AND w.incident_end AS i, w.incident_start FROM fx_metrics m JOIN windows w USING (bundle_id) WHERE b OR i"
CENTRED = "SELECT *, median(value) FILTER (b) OVER s AS bm, median(value) FILTER (i) OVER s AS im FROM tagged WINDOW s AS (PARTITION BY bundle_id, service_name, metric_name)"
STATS = """SELECT bundle_id, service_name, metric_name, first(bm) AS bm, first(im) AS im, count(*) FILTER (b) AS bn, count(*) FILTER (i) AS in_, median(abs(value - bm)) FILTER (b) AS mad FROM centred GROUP BY ALL"""
SCALED = """SELECT *, CASE WHEN bn < 2 THEN CASE WHEN coalesce(im, 0) <> 0 THEN abs(im) * 0.05::DOUBLE ELSE 1e-9::DOUBLE END
 ELSE greatest(mad * 1.4826::DOUBLE, abs(bm) * 0.05::DOUBLE, CASE WHEN bm = 0 AND coalesce(im, 0) <> 0 THEN abs(im) * 0.05::DOUBLE ELSE 1e-9::DOUBLE END) END AS scale FROM stats"""
SCORES = """SELECT bundle_id, service_name, metric_name, direction, round(CASE direction WHEN 'UP' THEN greatest(z, 0) WHEN 'DOWN' THEN greatest(-z, 0) ELSE abs(z) END, 4) + 0 AS score,
 coalesce(bm, 0) AS baseline_median, coalesce(im, 0) AS incident_median, bn AS baseline_points, in_ AS incident_points, bn >= 4 AND in_ >= 1 AS trustworthy,
 round(coalesce(im, 0) - coalesce(bm, 0), 6) AS delta, round((coalesce(im, 0) - coalesce(bm, 0)) / nullif(coalesce(bm, 0), 0), 6) AS relative_delta
 FROM (SELECT *, coalesce((im - bm) / scale, 0) AS z FROM scaled) JOIN fx_directions USING (metric_name)"""
CHAIN = {"windows": WINDOWS, "tagged": TAGGED, "centred": CENTRED, "stats": STATS, "scaled": SCALED, "scores": SCORES}
VIEWS = ("fx_metrics", "fx_windows", "fx_directions")


def _upto(last: str) -> dict[str, str]:
    names = list(CHAIN)
    return {n: CHAIN[n] for n in names[: names.index(last) + 1]}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _scores(s, d):
    return anomaly.score_services(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d)), P.fx_directions(s, d))


add("s01_scan_metrics", lambda s, d: P.fx_metrics(s, d), oracle("SELECT * FROM fx_metrics", "fx_metrics"))
add("p13_windows", lambda s, d: choose_windows(P.fx_windows(s, d)), oracle("SELECT * FROM windows", "fx_windows", windows=WINDOWS))
add(
    "j01_tagged", lambda s, d: tagged(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d))).groupBy("bundle_id", "service_name").agg(F.count_if("in_baseline").alias("baseline"), F.count_if("in_incident").alias("incident")),
    oracle("SELECT bundle_id, service_name, count(*) FILTER (b) AS baseline, count(*) FILTER (i) AS incident FROM tagged GROUP BY ALL", *VIEWS, **_upto("tagged")),
)
add(
    "a01_medians", lambda s, d: anomaly.window_medians(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d))),
    oracle("SELECT bundle_id, service_name, metric_name, median(value) FILTER (b) AS baseline_median, median(value) FILTER (i) AS incident_median, count(*) FILTER (b) AS baseline_points, count(*) FILTER (i) AS incident_points FROM tagged GROUP BY ALL", *VIEWS, **_upto("tagged")),
)
add(
    "a02_robust_scale", lambda s, d: anomaly.robust_stats(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d))).select(*anomaly.SERIES, F.round("mad", 6).alias("mad"), F.round("scale", 6).alias("scale")),
    oracle("SELECT bundle_id, service_name, metric_name, round(mad, 6) AS mad, round(scale, 6) AS scale FROM scaled", *VIEWS, **_upto("scaled")),
)
add("a03_robust_z", lambda s, d: _scores(s, d).select(*anomaly.SERIES, "direction", "score"), oracle("SELECT bundle_id, service_name, metric_name, direction, score FROM scores", *VIEWS, **CHAIN))
add(
    "a04_score_services",
    lambda s, d: anomaly.score_services(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d)), P.fx_directions(s, d), P.fx_metrics(s, d).select("bundle_id", "service_name").distinct()).select(*anomaly.SERIES, "score", "baseline_points", "incident_points", "trustworthy"),
    oracle("SELECT k.bundle_id, k.service_name, f.metric_name, coalesce(score, 0) AS score, coalesce(baseline_points, 0) AS baseline_points, coalesce(incident_points, 0) AS incident_points, coalesce(trustworthy, false) AS trustworthy FROM (SELECT DISTINCT bundle_id, service_name FROM fx_metrics) k CROSS JOIN fx_directions f LEFT JOIN scores x USING (bundle_id, service_name, metric_name)", *VIEWS, **CHAIN),
)
add("a05_trustworthy", lambda s, d: _scores(s, d).select(*anomaly.SERIES, "trustworthy", "delta", "relative_delta"), oracle("SELECT bundle_id, service_name, metric_name, trustworthy, delta, relative_delta FROM scores", *VIEWS, **CHAIN))
add(
    "a06_compare_windows", lambda s, d: anomaly.compare_windows(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d)), "inc_2", "svc-3", "error"),
    oracle("SELECT bundle_id, service_name, metric_name, bm AS baseline_median, im AS incident_median, round(coalesce((im - bm) / scale, 0), 4) AS score, bn >= 4 AS trustworthy, abs(coalesce((im - bm) / scale, 0)) >= 3 AS significant FROM scaled WHERE bundle_id = 'inc_2' AND service_name = 'svc-3' AND metric_name = 'error'", *VIEWS, **_upto("scaled")),
)
WORST = "SELECT bundle_id, service_name, greatest(max(score), 0) AS anomaly FROM scores WHERE trustworthy GROUP BY ALL"
add("a07_worst_scores", lambda s, d: anomaly.worst_scores(_scores(s, d)), oracle(WORST, *VIEWS, **CHAIN))
add("p08_exclusion", lambda s, d: anomaly.worst_scores(_scores(s, d), ["svc-0", "svc-5"]), oracle(WORST.replace("WHERE trustworthy", "WHERE trustworthy AND service_name NOT IN ('svc-0', 'svc-5')"), *VIEWS, **CHAIN))
RANKED = "SELECT bundle_id, service_name, metric_name, score, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, service_name, metric_name) AS place FROM scores WHERE trustworthy"
_PLACED = ["bundle_id", "service_name", "metric_name", "score", "place"]
add("t01_rank_anomalies", lambda s, d: anomaly.rank_anomalies(_scores(s, d)).select(*_PLACED), oracle(RANKED, *VIEWS, **CHAIN))
add("t02_list_anomalies", lambda s, d: anomaly.rank_anomalies(_scores(s, d), 0.5, 8).select(*_PLACED), oracle(f"SELECT * FROM ({RANKED} AND score >= 0.5) WHERE place <= 8", *VIEWS, **CHAIN))
add("t03_top_anomalies", lambda s, d: anomaly.rank_anomalies(_scores(s, d), 0.0, 5).groupBy("bundle_id").agg(F.max("score").alias("top_anomaly"), F.count("*").alias("kept")), oracle(f"SELECT bundle_id, max(score) AS top_anomaly, count(*) AS kept FROM ({RANKED}) WHERE place <= 5 GROUP BY 1", *VIEWS, **CHAIN))
add(
    "g14_anomaly_only", lambda s, d: anomaly.services_by_score(_scores(s, d)),
    oracle(f"SELECT bundle_id, service_name, score, row_number() OVER (PARTITION BY bundle_id ORDER BY p) AS place FROM (SELECT bundle_id, service_name, max(score) AS score, min(place) AS p FROM ({RANKED}) GROUP BY ALL)", *VIEWS, **CHAIN),
)
ONSETS = """SELECT bundle_id, service_name, round(min((epoch_us(timestamp) - epoch_us(incident_start)) / 1000000.0::DOUBLE), 6) AS onset_seconds FROM (
 SELECT *, count(*) FILTER (b) OVER s AS bn, median(abs(value - bm)) FILTER (b) OVER s AS mad FROM centred WINDOW s AS (PARTITION BY bundle_id, service_name, metric_name))
 WHERE i AND bn >= 4 AND (value - bm) / greatest(mad * 1.4826::DOUBLE, abs(bm) * 0.05::DOUBLE, 1e-9::DOUBLE) >= {k} GROUP BY ALL"""
add("w03_onset", lambda s, d: anomaly.onsets(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d)), 1.5), oracle(ONSETS.format(k="1.5"), *VIEWS, **_upto("centred")))
add(
    "w04_started_first", lambda s, d: anomaly.started_first(anomaly.onsets(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d)), 1.5)),
    oracle(f"SELECT *, onset_seconds <= min(onset_seconds) OVER (PARTITION BY bundle_id) AS started_first FROM ({ONSETS.format(k='1.5')})", *VIEWS, **_upto("centred")),
)
ZERO = TAGGED.replace("fx_metrics", "fx_error_counts")
add(
    "a02_zero_baseline",
    lambda s, d: anomaly.robust_stats(P.fx_error_counts(s, d), choose_windows(P.fx_windows(s, d))).select(*anomaly.SERIES, "baseline_points", F.round("scale", 9).alias("scale")),
    oracle("SELECT bundle_id, service_name, metric_name, bn AS baseline_points, round(scale, 9) AS scale FROM scaled", "fx_error_counts", *VIEWS, **(_upto("scaled") | {"tagged": ZERO})),
)
GAPS = "SELECT bundle_id, round(max(g), 6) AS max_gap, round(median(g), 6) AS median_gap, count(*) AS samples FROM (SELECT bundle_id, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY bundle_id ORDER BY timestamp)) / 1000000.0::DOUBLE AS g FROM (SELECT DISTINCT bundle_id, timestamp FROM fx_metrics)) GROUP BY 1"
add("w01_gaps", lambda s, d: continuity.gaps(P.fx_metrics(s, d)), oracle(GAPS, "fx_metrics"))
add("w02_continuity", lambda s, d: continuity.continuity(continuity.gaps(P.fx_metrics(s, d))), oracle(f"SELECT *, CASE WHEN samples < 3 THEN 'unknown' WHEN max_gap > greatest(4 * median_gap, 120) THEN 'broken' ELSE 'continuous' END AS verdict FROM ({GAPS})", "fx_metrics"))
add(
    "v18_sparse_windows", lambda s, d: continuity.sparse_windows(P.fx_metrics(s, d), 43_200, 3),
    oracle("SELECT bundle_id, service_name, metric_name, time_bucket(INTERVAL 12 HOURS, timestamp, TIMESTAMP '1970-01-01') AS window_start, count(*) AS samples FROM fx_metrics GROUP BY ALL HAVING count(*) < 3", "fx_metrics"),
)
add(
    "v17_drift",
    lambda s, d: continuity.recording_drift(P.table(s, d, "orders").select("o_orderkey", F.lit(600.0).alias("planned_seconds"), (F.col("o_totalprice") / 300).alias("actual_seconds"))).select("o_orderkey", "drifted"),
    "SELECT o_orderkey, o_totalprice / 300 > greatest(600 * 1.5, 900) AS drifted FROM orders",
)
_T = ("2024-01-03", "2024-01-12 12:00:00")
_BETWEEN = f"timestamp BETWEEN TIMESTAMP '{_T[0]}' AND TIMESTAMP '{_T[1]}'"
add("p01_query_metrics", lambda s, d: lookups.query_metrics(P.fx_metrics(s, d), "error", *_T, ["svc-1", "svc-2"]).select("timestamp", "service_name", "value"), oracle(f"SELECT timestamp, service_name, value FROM fx_metrics WHERE metric_name = 'error' AND {_BETWEEN} AND service_name IN ('svc-1', 'svc-2') ORDER BY timestamp, service_name, value LIMIT 50", "fx_metrics"))
add("p02_metric_series", lambda s, d: lookups.metric_series(P.fx_metrics(s, d), "view", *_T).select("service_name", "timestamp", "value"), oracle(f"SELECT service_name, timestamp, value FROM fx_metrics WHERE metric_name = 'view' AND {_BETWEEN}", "fx_metrics"))
add("p07_errors_only", lambda s, d: lookups.errors_only(P.fx_metrics(s, d), "$.k", "42").select("bundle_id", "timestamp", "value"), oracle("SELECT bundle_id, timestamp, value FROM fx_metrics WHERE json_extract_string(labels_json, '$.k') = '42'", "fx_metrics"))
add("p09_known_services", lambda s, d: lookups.known_services(P.fx_metrics(s, d)), oracle("SELECT DISTINCT service_name FROM fx_metrics", "fx_metrics"))
add("p11_vocabulary", lambda s, d: outside_vocabulary(P.fx_metrics(s, d), "metric_name", P.fx_directions(s, d).filter("direction <> 'DOWN'").select("metric_name")), oracle("SELECT DISTINCT metric_name FROM fx_metrics WHERE metric_name NOT IN ('click', 'error', 'signup', 'view')", "fx_metrics"))
add("p12_iso", lambda s, d: P.fx_metrics(s, d).select("bundle_id", C.iso_utc(F.col("timestamp")).alias("iso"), "value"), oracle("SELECT bundle_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, value FROM fx_metrics", "fx_metrics"))
add("p14_window_facts", lambda s, d: lookups.window_facts(P.fx_metrics(s, d), ["bundle_id", "metric_name"]), oracle("SELECT bundle_id, metric_name, max(value) AS max_value, min(value) AS min_value, count(*) AS samples FROM fx_metrics GROUP BY ALL", "fx_metrics"))
_SIDE = "SELECT service_name, metric_name, round(avg(value), 6) AS value FROM fx_metrics WHERE bundle_id = '{b}' AND {c} GROUP BY ALL"
add(
    "p15_signal_changed",
    lambda s, d: lookups.signal_changed(
        *(P.fx_metrics(s, d).filter(f"bundle_id = '{b}' and {c}").groupBy("service_name", "metric_name").agg(F.round(F.avg("value"), 6).alias("value")) for b, c in (("inc_0", "service_name <> 'svc-0'"), ("inc_1", "metric_name <> 'view'"))), ["service_name", "metric_name"], 0.05
    ),
    oracle("SELECT service_name, metric_name, a.value AS before, b.value AS after, CASE WHEN b.value IS NULL THEN false WHEN a.value IS NULL OR a.value = 0 THEN coalesce(b.value <> 0, false) ELSE abs(b.value - a.value) / abs(a.value) > 0.05::DOUBLE END AS changed FROM a FULL JOIN b USING (service_name, metric_name)", "fx_metrics", a=_SIDE.format(b="inc_0", c="service_name <> 'svc-0'"), b=_SIDE.format(b="inc_1", c="metric_name <> 'view'")),
)
add("p06_changes", lambda s, d: lookups.recent_changes(P.fx_changes(s, d), "1996-01-01", "1997-06-30", ["svc-1"]), oracle('SELECT * FROM fx_changes WHERE "at" BETWEEN TIMESTAMP \'1996-01-01\' AND TIMESTAMP \'1997-06-30\' AND service = \'svc-1\'', "fx_changes"))
_POINTS = "SELECT 'svc-' || (user_id % 8) AS key, event_id AS point_id, ts AS at FROM events WHERE event_type = 'purchase'"
_ALERTS = "SELECT 'svc-' || (user_id % 8) AS key, ts AS at, event_id AS alert FROM events WHERE event_type = 'error'"


def _events(s, d, kind, key):
    return P.table(s, d, "events").filter(F.col("event_type") == kind).select(F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("key"), F.col("event_id").alias(key), F.col("ts").cast("timestamp").alias("at"))


add(
    "j14_first_alert", lambda s, d: lookups.first_alert_after(_events(s, d, "purchase", "point_id"), _events(s, d, "error", "alert"), 7200),
    oracle("SELECT p.key, p.point_id, p.at, min(a.at) AS alert_at, min_by(a.alert, (a.at, a.alert)) AS alert FROM p LEFT JOIN a ON a.key = p.key AND a.at >= p.at AND epoch_us(a.at) <= epoch_us(p.at) + 7200000000 GROUP BY ALL", p=_POINTS, a=_ALERTS),
)
add(
    "j15_changes_near",
    lambda s, d: lookups.changes_near(_events(s, d, "signup", "change_id").select(F.col("key").alias("service"), F.col("change_id").alias("onset"), F.col("at").alias("onset_at")), _events(s, d, "error", "change").withColumnRenamed("key", "service"), 1800).select("service", "onset", "change", F.round("seconds_before", 3).alias("seconds_before")),
    oracle("SELECT s.key AS service, s.point_id AS onset, a.alert AS change, round((epoch_us(s.at) - epoch_us(a.at)) / 1000000.0::DOUBLE, 3) AS seconds_before FROM s JOIN a ON s.key = a.key AND a.at <= s.at AND epoch_us(a.at) >= epoch_us(s.at) - 1800000000", s=_POINTS.replace("purchase", "signup"), a=_ALERTS),
)
add(
    "s14_append_new", lambda s, d: governance.without_known(P.table(s, d, "events").select("user_id", "event_id", "value"), P.table(s, d, "events").filter("event_type = 'error' and event_id < 200").select("user_id"), "user_id", ["event_id"]),
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id < 200)",
)
add("u05_differences", lambda s, d: lookups.field_differences(P.table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), P.table(s, d, "orders").filter("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority"), "o_orderkey"),
    "SELECT a.o_orderkey, field, first, second FROM (SELECT a.o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']) AS field, unnest([a.o_orderstatus, a.o_orderpriority]) AS first, unnest([b.s, b.p]) AS second FROM orders a LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0) b USING (o_orderkey)) a WHERE first IS DISTINCT FROM second")
add(
    "w06_recovery",
    lambda s, d: governance.recovery(
        P.table(s, d, "orders").join(P.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.col("l_shipdate").cast("timestamp").alias("at"), F.col("o_orderdate").cast("timestamp").alias("acted_at"), "o_totalprice").agg(F.min(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))).alias("value")).withColumn("baseline", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 8)),
        "o_orderkey", 2, 40_000_000.0,
    ),
    """WITH x AS (SELECT o_orderkey, l_shipdate AS "at", o_orderdate AS acted_at, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 8 END AS baseline, min(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
 r AS (SELECT *, CASE WHEN value <= CASE WHEN baseline > 0 THEN baseline * 1.25::DOUBLE ELSE 0.00125::DOUBLE END THEN 1 ELSE 0 END AS inside, (epoch_us(x."at") - epoch_us(acted_at)) / 1000000.0::DOUBLE AS since FROM x WHERE value IS NOT NULL),
 h AS (SELECT *, sum(inside) OVER (PARTITION BY o_orderkey ORDER BY r."at" ROWS 1 PRECEDING) AS held, row_number() OVER (PARTITION BY o_orderkey ORDER BY r."at") AS n FROM r WHERE since BETWEEN 0 AND 40000000),
 f AS (SELECT o_orderkey, count(*) AS readings, min(since) FILTER (held = 2 AND n >= 2) AS after FROM h GROUP BY 1),
 e AS (SELECT o_orderkey, max(baseline) AS baseline FROM x GROUP BY 1)
SELECT o_orderkey, CASE WHEN baseline IS NULL OR readings IS NULL THEN 'unknown' WHEN after IS NOT NULL THEN 'recovered' ELSE 'not_recovered' END AS status, round(after, 6) AS recovered_after FROM e LEFT JOIN f USING (o_orderkey)""",
)
add("a14_rank_summary", lambda s, d: grading.ranking_summary(anomaly.rank_anomalies(_scores(s, d)).withColumn("place", F.when(F.col("place") % 4 != 0, F.col("place"))), "service_name"),
    oracle(f"SELECT service_name, count(*) AS trials, count(*) FILTER (place = 1) AS top1, count(*) FILTER (place <= 3) AS top3, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM (SELECT service_name, CASE WHEN place % 4 <> 0 THEN place END AS place FROM ({RANKED})) GROUP BY ROLLUP (service_name)", *VIEWS, **CHAIN))
add("a14_rank_histogram", lambda s, d: grading.rank_histogram(anomaly.rank_anomalies(_scores(s, d))), oracle(f"SELECT place, count(*) AS trials FROM ({RANKED}) GROUP BY 1", *VIEWS, **CHAIN))
