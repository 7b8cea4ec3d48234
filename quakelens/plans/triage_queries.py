"""Queries that run the whole triage, and its parameter sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelens.operators import anomaly
from quakelens.operators.windows import choose_windows
from quakelens.plans import graph, triage
from quakelens.plans.graph_queries import GRAPH, LEAF, MOVES, SETTLED, walk
from quakelens.plans.metric_queries import CHAIN, ONSETS
from quakelens.sources import projections as P
from quakelens.sources.projections import Query, oracle

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _edges(s, d):
    """Calls between the services of the metric projection, from events that follow each other in an hour."""
    m = P.fx_metrics(s, d)
    hour = m.select("bundle_id", F.date_trunc("hour", "timestamp").alias("h"), "service_name", "metric_name")
    a, b = hour.groupBy("bundle_id", "h", F.col("service_name").alias("client")).agg(F.count("*").alias("x")), hour.groupBy("bundle_id", "h", F.col("service_name").alias("server")).agg(F.count("*").alias("y"))
    near = a.join(b, ["bundle_id", "h"]).filter("client < server")
    return near.groupBy("bundle_id", "client", "server").agg((F.sum(F.least("x", "y")) / 86400.0).alias("requests_per_second"))


THRESHOLD = 0.6


def _triage(s, d, threshold: float = THRESHOLD):
    return triage.triage(P.fx_metrics(s, d), P.fx_windows(s, d), _edges(s, d), P.fx_directions(s, d), threshold)


def _report(s, d):
    moved = P.fx_changes(s, d).withColumn("at", F.timestamp_micros(F.unix_micros("at") + 820_000_000_000_000 - 730_000_000_000_000))
    onset_times = anomaly.onsets(P.fx_metrics(s, d), choose_windows(P.fx_windows(s, d)))
    found = triage.report_rows(_triage(s, d), P.fx_windows(s, d), _edges(s, d), moved, onset_times, THRESHOLD)
    return found.withColumns({c: F.array_join(c, ",") for c in ("candidates", "blast_radius", "onset_order", "cited")})


SWEEP = {"default": {}, "no_scaling": {"scaling": False}, "self_loops": {"loops": 0.5}, "backward": {"backward": 0.3}, "published": {"loops": 0.5, "backward": 0.3, "sharpness": 2.0}, "sharp2": {"sharpness": 2.0}, "sharp3": {"sharpness": 3.0}, "no_bonus": {"bonus": 1.0}}


def _scores(s, d):
    return P.fx_edges(s, d).select("bundle_id").distinct().crossJoin(F.broadcast(P.fx_anomaly(s, d)))  # a score of every node in every bundle


# The twin of g13: scores and onsets as in metric_queries, the walk as in graph_queries.
_HOURS = "SELECT bundle_id, date_trunc('hour', timestamp) AS h, service_name AS service, count(*) AS n FROM fx_metrics GROUP BY ALL"
_VIEWS = {
    **{{"scaled": "scales"}.get(k, k): v.replace("FROM scaled)", "FROM scales)") for k, v in CHAIN.items()},
    "worst": "SELECT bundle_id, service_name AS service, greatest(max(score), 0) AS anomaly FROM scores WHERE trustworthy GROUP BY ALL",
    "onsets": ONSETS.format(k="3"),
    "hours": _HOURS,
    "g": "SELECT a.bundle_id, a.service AS client, b.service AS server, sum(least(a.n, b.n)) / 86400.0::DOUBLE AS weight FROM hours a JOIN hours b USING (bundle_id, h) WHERE a.service < b.service GROUP BY ALL",
    "scaled": """SELECT g.bundle_id, client, server, weight * sqrt(1 + coalesce(a.anomaly, 0)) * sqrt(1 + coalesce(b.anomaly, 0)) AS weight FROM g
 LEFT JOIN worst a ON a.bundle_id = g.bundle_id AND a.service = client LEFT JOIN worst b ON b.bundle_id = g.bundle_id AND b.service = server""",
    "raw": """SELECT n.bundle_id, n.service, coalesce(w.anomaly, 0.0::DOUBLE) AS anomaly FROM (SELECT bundle_id, client AS service FROM g UNION SELECT bundle_id, server FROM g UNION SELECT bundle_id, service FROM worst) n
 LEFT JOIN worst w USING (bundle_id, service)""",
    "restart": """SELECT bundle_id, service, anomaly, CASE WHEN sum(anomaly) OVER p > 0 THEN anomaly / sum(anomaly) OVER p ELSE 1.0::DOUBLE / count(*) OVER p END AS restart
 FROM raw WINDOW p AS (PARTITION BY bundle_id)""",
    "nodes": LEAF,
    "moves": MOVES,
}
_CANDIDATES = f"""SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, service) AS place FROM (
 SELECT bundle_id, service, round(rank, 10) AS g, round(rank * CASE WHEN onset_seconds <= min(onset_seconds) OVER (PARTITION BY bundle_id) THEN 1.25::DOUBLE ELSE 1 END, 10) AS score
 FROM r{SETTLED} LEFT JOIN (SELECT bundle_id, service_name AS service, onset_seconds FROM onsets) USING (bundle_id, service))"""
ORACLE["g13_triage"] = f"""{oracle("", "fx_metrics", "fx_windows", "fx_directions", **_VIEWS).rstrip()}, {walk(SETTLED)}, candidates AS ({_CANDIDATES}),
 pairs AS (SELECT bundle_id, max(service) FILTER (place = 1) AS service, max(g) FILTER (place = 1) AS a, max(g) FILTER (place = 2) AS b, string_agg(service, ',' ORDER BY place) FILTER (place <= 5) AS candidates FROM candidates GROUP BY 1),
 tops AS (SELECT bundle_id, max(anomaly) AS top FROM worst GROUP BY 1)
SELECT bundle_id, coalesce(top, 0) AS top_anomaly, coalesce(top, 0) < {THRESHOLD} AS abstained, CASE WHEN top >= {THRESHOLD} THEN service END AS root_cause,
 CASE WHEN top >= {THRESHOLD} THEN CASE WHEN b IS NULL THEN 0.35::DOUBLE WHEN b <= 0 THEN 0.85::DOUBLE ELSE round(0.35::DOUBLE + 0.5::DOUBLE * (1 - 1 / greatest(a / b, 1)), 4) END END AS confidence, candidates
FROM pairs LEFT JOIN tops USING (bundle_id)"""
QUERIES["g13_triage"] = lambda s, d: _triage(s, d).withColumn("candidates", F.array_join("candidates", ","))
QUERIES["g15_report_rows"] = _report


def _settings(s):
    default = {"scaling": True, "loops": 0.0, "backward": 0.0, "sharpness": graph.SHARPNESS, "bonus": graph.ONSET_BONUS}
    return s.createDataFrame([(name, *(default | own).values()) for name, own in SWEEP.items()], "configuration string, scaling boolean, loops double, backward double, sharpness double, bonus double")


QUERIES["e21_sweep"] = lambda s, d: graph.rank_under_settings(P.fx_edges(s, d), _scores(s, d), _settings(s)).filter("place <= 3").select("configuration", "bundle_id", "service", "place")
_CFG = ", ".join(f"('{n}', {str(c.get('scaling', True)).lower()}, {float(c.get('loops', 0))}::DOUBLE, {float(c.get('backward', 0))}::DOUBLE, {float(c.get('sharpness', 1))}::DOUBLE)" for n, c in SWEEP.items())
_SWEPT = {
    "cfg": f"SELECT * FROM (VALUES {_CFG}) v(name, scaling, loops, backward, sharpness)",
    "base": GRAPH,
    "g": """SELECT name || '|' || of AS bundle_id, name, client, server, sum(weight) AS weight FROM (SELECT name, bundle_id AS of, client, server, weight FROM base, cfg
 UNION ALL SELECT name, bundle_id, server, client, weight * backward FROM base, cfg WHERE backward > 0) GROUP BY ALL""",
    "scored": "SELECT name || '|' || bundle_id AS bundle_id, name, bundle_id AS of, service, anomaly FROM (SELECT DISTINCT bundle_id FROM fx_edges), fx_anomaly, cfg",
    "weighed": """SELECT bundle_id, name, client, server, weight * CASE WHEN scaling THEN sqrt(1 + a.anomaly) * sqrt(1 + b.anomaly) ELSE 1 END AS weight FROM g JOIN cfg USING (name)
 JOIN fx_anomaly a ON a.service = client JOIN fx_anomaly b ON b.service = server""",
    "scaled": """SELECT bundle_id, client, server, sum(weight) AS weight FROM (SELECT bundle_id, client, server, weight FROM weighed UNION ALL
 SELECT s.bundle_id, s.service, s.service, CASE WHEN o > 0 THEN o * loops ELSE 1 END FROM scored s JOIN cfg USING (name) LEFT JOIN (SELECT bundle_id, client AS service, sum(weight) AS o FROM weighed GROUP BY ALL) t USING (bundle_id, service) WHERE loops > 0) GROUP BY ALL""",
    "restart": """SELECT bundle_id, service, CASE WHEN sum(raw) OVER p > 0 THEN raw / sum(raw) OVER p ELSE 1.0::DOUBLE / count(*) OVER p END AS restart
 FROM (SELECT s.*, pow(greatest(anomaly, 0), sharpness) AS raw FROM scored s JOIN cfg USING (name)) WINDOW p AS (PARTITION BY bundle_id)""",
    "nodes": LEAF,
    "moves": MOVES,
}
ORACLE["e21_sweep"] = f"""{oracle("", "fx_edges", "fx_anomaly", **_SWEPT).rstrip()}, {walk(SETTLED)} SELECT name AS configuration, of AS bundle_id, service, place FROM (
 SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY round(rank, 10) DESC, service) AS place FROM r{SETTLED} JOIN (SELECT DISTINCT bundle_id, name, of FROM scored) USING (bundle_id)) WHERE place <= 3"""
FRACTIONS = (0.2, 0.25, 0.3333333333333333, 0.4)


def _truths(s, d):
    """The service with the most errors of each bundle."""
    errors = P.fx_metrics(s, d).filter("metric_name = 'error'").groupBy("bundle_id", "service_name").agg(F.count("*").alias("n"))
    return errors.groupBy("bundle_id").agg(F.max_by("service_name", F.struct("n", "service_name")).alias("truth"))


def _trials(s, d):
    fractions = {f"fraction_{f:.4f}": f for f in FRACTIONS}
    return triage.fraction_trials(P.fx_metrics(s, d), P.fx_windows(s, d), _edges(s, d), P.fx_directions(s, d), _truths(s, d), fractions)


QUERIES["e21_fraction_sweep"] = _trials

# The fractions' twin: the views of g13 over metrics and windows that stand once for each fraction.
_FRACTIONS = ", ".join(f"('fraction_{f:.4f}', {f!r}::DOUBLE)" for f in FRACTIONS)
_UNDER = {
    "fractions": f"SELECT * FROM (VALUES {_FRACTIONS}) v(configuration, fraction)",
    "m0": P.SQL["fx_metrics"],
    "w0": P.SQL["fx_windows"].replace("FROM fx_metrics", "FROM m0"),
    "fx_metrics": "SELECT configuration || '|' || bundle_id AS bundle_id, * EXCLUDE (bundle_id, configuration, fraction) FROM m0, fractions",
    "fx_windows": "SELECT configuration || '|' || bundle_id AS bundle_id, * EXCLUDE (bundle_id, configuration) FROM w0, fractions",
    "fx_directions": P.SQL["fx_directions"],
    **_VIEWS,
}
_UNDER["windows"] = _UNDER["windows"].replace("0.3333333333333333::DOUBLE", "fraction")
ORACLE["e21_fraction_sweep"] = f"""{oracle("", **_UNDER).rstrip()}, {walk(SETTLED)}, candidates AS ({_CANDIDATES}),
 truths AS (SELECT bundle_id, max_by(service_name, (n, service_name)) AS service FROM (SELECT bundle_id, service_name, count(*) AS n FROM fx_metrics WHERE metric_name = 'error' GROUP BY ALL) GROUP BY 1),
 differing AS (SELECT bundle_id, count(DISTINCT onset_seconds) AS k FROM onsets GROUP BY 1)
SELECT split_part(w.bundle_id, '|', 1) AS configuration, count(*) AS trials, count(*) FILTER (place = 1) AS top1, count(*) FILTER (place <= 3) AS top3, count(*) FILTER (k > 1) AS onset_order_survives,
 round(count(*) FILTER (k > 1) / count(*), 4) AS survival_share FROM fx_windows w LEFT JOIN (SELECT bundle_id, place FROM candidates JOIN truths USING (bundle_id, service)) USING (bundle_id) LEFT JOIN differing USING (bundle_id) GROUP BY 1"""
