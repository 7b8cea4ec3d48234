"""Queries over call edges and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelens.operators import governance, grading, lookups, topology, traces
from quakelens.plans import graph
from quakelens.sources import projections as P
from quakelens.sources.projections import Query, oracle
from quakelens.sources.staging import staged

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ROUNDS = 12
SETTLED = 130  # rounds after which 0.85 ** rounds is below the walk's tolerance


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def _scores(s, d):
    bundles = P.fx_edges(s, d).select("bundle_id").distinct()
    return bundles.crossJoin(F.broadcast(P.fx_anomaly(s, d)))  # a score of every node in every bundle


GRAPH = "SELECT bundle_id, client, server, sum(requests_per_second) AS weight FROM fx_edges GROUP BY ALL"
SCORED = "SELECT bundle_id, service, anomaly FROM (SELECT DISTINCT bundle_id FROM fx_edges) CROSS JOIN fx_anomaly"
SCALED = "SELECT g.bundle_id, client, server, weight * sqrt(1 + a.anomaly) * sqrt(1 + b.anomaly) AS weight FROM g JOIN fx_anomaly a ON a.service = client JOIN fx_anomaly b ON b.service = server"
RESTART = "SELECT bundle_id, service, CASE WHEN sum(anomaly) OVER p > 0 THEN anomaly / sum(anomaly) OVER p ELSE 1.0::DOUBLE / count(*) OVER p END AS restart FROM scored WINDOW p AS (PARTITION BY bundle_id)"
MOVES = "SELECT bundle_id, client, server, 0.85::DOUBLE * weight / sum(weight) OVER (PARTITION BY bundle_id, client) AS p FROM scaled"
LEAF = "SELECT r.*, NOT EXISTS (SELECT 1 FROM scaled x WHERE x.bundle_id = r.bundle_id AND x.client = r.service) AS leaf FROM restart r"


def walk(rounds: int) -> str:
    """A fixed number of rounds as a chain of materialised tables."""
    parts = ["r0 AS MATERIALIZED (SELECT bundle_id, service, restart AS rank FROM nodes)"]
    for k in range(rounds):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT n.bundle_id, n.service, (0.85::DOUBLE * l.lost + 0.15::DOUBLE) * n.restart + coalesce(s.got, 0) AS rank FROM nodes n "
            f"JOIN (SELECT bundle_id, coalesce(sum(rank) FILTER (leaf), 0) AS lost FROM r{k} JOIN nodes USING (bundle_id, service) GROUP BY 1) l USING (bundle_id) "
            f"LEFT JOIN (SELECT m.bundle_id, m.server AS service, sum(rank * p) AS got FROM r{k} JOIN moves m ON m.bundle_id = r{k}.bundle_id AND m.client = r{k}.service GROUP BY ALL) s USING (bundle_id, service))"
        )
    return ", ".join(parts)


def _ranked(body: str, rounds: int = SETTLED) -> str:
    head = oracle("", "fx_edges", "fx_anomaly", g=GRAPH, scored=SCORED, scaled=SCALED, restart=RESTART, nodes=LEAF, moves=MOVES).rstrip()
    return f"{head}, {walk(rounds)} {body}"


def _graph(s, d):
    return graph.call_graph(P.fx_edges(s, d))


add("a09_call_graph", lambda s, d: _graph(s, d).withColumn("weight", F.round("weight", 9)), oracle("SELECT bundle_id, client, server, round(weight, 9) AS weight FROM g", "fx_edges", g=GRAPH))
add("g01_nodes", lambda s, d: graph.graph_nodes(_graph(s, d), _scores(s, d).filter("anomaly > 4.5")), oracle("SELECT bundle_id, client AS service FROM g UNION SELECT bundle_id, server FROM g UNION SELECT bundle_id, service FROM scored WHERE anomaly > 4.5", "fx_edges", "fx_anomaly", g=GRAPH, scored=SCORED))
add("u02_services", lambda s, d: P.fx_edges(s, d).select(F.col("client").alias("service")).union(P.fx_edges(s, d).select("server")).distinct(), oracle("SELECT client AS service FROM fx_edges UNION SELECT server FROM fx_edges", "fx_edges"))
add("g02_backward", lambda s, d: graph.with_backward_edges(_graph(s, d), 0.3).withColumn("weight", F.round("weight", 9)), oracle("SELECT bundle_id, client, server, round(sum(weight), 9) AS weight FROM (SELECT * FROM g UNION ALL SELECT bundle_id, server, client, weight * 0.3::DOUBLE FROM g) GROUP BY ALL", "fx_edges", g=GRAPH))
add(
    "g03_self_loops", lambda s, d: graph.with_self_loops(_graph(s, d), graph.graph_nodes(_graph(s, d), _scores(s, d)), 0.5).withColumn("weight", F.round("weight", 9)),
    oracle("SELECT bundle_id, client, server, round(sum(weight), 9) AS weight FROM (SELECT * FROM g UNION ALL SELECT n.bundle_id, n.service, n.service, CASE WHEN o > 0 THEN o * 0.5::DOUBLE ELSE 1 END FROM (SELECT bundle_id, service FROM scored UNION SELECT bundle_id, client FROM g UNION SELECT bundle_id, server FROM g) n LEFT JOIN (SELECT bundle_id, client AS service, sum(weight) AS o FROM g GROUP BY ALL) USING (bundle_id, service)) GROUP BY ALL", "fx_edges", "fx_anomaly", g=GRAPH, scored=SCORED),
)
add("g04_scaling", lambda s, d: graph.scaled_by_endpoints(_graph(s, d), _scores(s, d)).withColumn("weight", F.round("weight", 9)), oracle("SELECT bundle_id, client, server, round(weight, 9) AS weight FROM scaled", "fx_edges", "fx_anomaly", g=GRAPH, scaled=SCALED))
add("g05_restart", lambda s, d: graph.restart_vector(graph.graph_nodes(_graph(s, d), _scores(s, d)), _scores(s, d)).withColumn("restart", F.round("restart", 9)), oracle("SELECT bundle_id, service, round(restart, 9) AS restart FROM restart", "fx_edges", "fx_anomaly", scored=SCORED, restart=RESTART))
add(
    "g06_pagerank_rounds",
    lambda s, d: graph.pagerank_rounds(graph.scaled_by_endpoints(_graph(s, d), _scores(s, d)), graph.restart_vector(graph.graph_nodes(_graph(s, d), _scores(s, d)), _scores(s, d)), ROUNDS).withColumn("graph_score", F.round("graph_score", 8)),
    _ranked(f"SELECT bundle_id, service, round(rank, 8) AS graph_score FROM r{ROUNDS}", ROUNDS),
)
add("g06_pagerank", lambda s, d: graph.pagerank(graph.scaled_by_endpoints(_graph(s, d), _scores(s, d)), graph.restart_vector(graph.graph_nodes(_graph(s, d), _scores(s, d)), _scores(s, d))).withColumn("graph_score", F.round("graph_score", 6)), _ranked(f"SELECT bundle_id, service, round(rank, 6) AS graph_score FROM r{SETTLED}"))


def _candidates(s, d):
    return graph.rank_candidates(P.fx_edges(s, d), _scores(s, d))


PLACED = f"SELECT bundle_id, service, round(rank, 6) AS graph_score, row_number() OVER (PARTITION BY bundle_id ORDER BY round(rank, 10) DESC, service) AS place FROM r{SETTLED}"
add("g07_rank_candidates", lambda s, d: _candidates(s, d).select("bundle_id", "service", F.round("graph_score", 6).alias("graph_score"), "place"), _ranked(PLACED))
CONFIDENCE = f"SELECT bundle_id, service, CASE WHEN b IS NULL THEN 0.35::DOUBLE WHEN b <= 0 THEN 0.85::DOUBLE ELSE round(0.35::DOUBLE + 0.5::DOUBLE * (1 - 1 / greatest(a / b, 1)), 4) END AS confidence FROM (SELECT bundle_id, max(service) FILTER (place = 1) AS service, max(g) FILTER (place = 1) AS a, max(g) FILTER (place = 2) AS b FROM (SELECT *, round(rank, 10) AS g, row_number() OVER (PARTITION BY bundle_id ORDER BY round(rank, 10) DESC, service) AS place FROM r{SETTLED}) GROUP BY 1)"
add("g11_confidence", lambda s, d: graph.confidence(_candidates(s, d)), _ranked(CONFIDENCE))


def _tops(s, d):
    return _scores(s, d).groupBy("bundle_id").agg(F.round(F.max("anomaly") + F.pmod(F.col("bundle_id").cast("int"), F.lit(3)), 6).alias("top_anomaly"))


add(
    "g12_abstention", lambda s, d: graph.abstained(graph.confidence(_candidates(s, d)), _tops(s, d), 7.0),
    _ranked(f"SELECT bundle_id, top_anomaly, top_anomaly < 7 AS abstained, CASE WHEN top_anomaly >= 7 THEN service END AS root_cause, CASE WHEN top_anomaly >= 7 THEN confidence END AS confidence FROM ({CONFIDENCE}) JOIN (SELECT bundle_id, round(max(anomaly) + CAST(bundle_id AS INT) % 3, 6) AS top_anomaly FROM scored GROUP BY bundle_id) USING (bundle_id)"),
)


def _starts(s, d):
    return P.fx_edges(s, d).select("bundle_id", F.col("client").alias("start")).distinct()


def _reach(a: str, b: str, depth: int) -> str:
    return f"SELECT DISTINCT bundle_id, client AS start, client AS service, 0 AS depth FROM fx_edges UNION SELECT w.bundle_id, w.start, e.{b}, w.depth + 1 FROM walk w JOIN fx_edges e ON e.bundle_id = w.bundle_id AND e.{a} = w.service WHERE w.depth < {depth}"


def _hops(a: str, b: str, word: str) -> str:
    return f"SELECT x.bundle_id, x.start, e.client, e.server, e.{b} AS neighbour, '{word}' AS direction, y.depth FROM least_ x JOIN fx_edges e ON e.bundle_id = x.bundle_id AND e.{a} = x.service JOIN least_ y ON y.bundle_id = x.bundle_id AND y.start = x.start AND y.service = e.{b} WHERE y.depth = x.depth + 1"


LEAST = "SELECT bundle_id, start, service, min(depth) AS depth FROM walk GROUP BY ALL"
add("g08_dependencies", lambda s, d: graph.dependencies(P.fx_edges(s, d), _starts(s, d)), oracle(_hops("client", "server", "downstream"), "fx_edges", walk=_reach("client", "server", 3), least_=LEAST))
add("g09_reachable", lambda s, d: graph.reachable(P.fx_edges(s, d), _starts(s, d)), oracle("SELECT * FROM least_ WHERE depth > 0", "fx_edges", walk=_reach("client", "server", 3), least_=LEAST))
add("g10_blast_radius", lambda s, d: graph.blast_radius(P.fx_edges(s, d), _starts(s, d)), oracle("SELECT bundle_id, start, service, depth AS level FROM least_ WHERE depth > 0", "fx_edges", walk=_reach("server", "client", 12), least_=LEAST))
add("u01_both_directions", lambda s, d: graph.both_directions(P.fx_edges(s, d), _starts(s, d), 1), oracle("SELECT DISTINCT bundle_id, server AS start, client, server, client AS neighbour, 'upstream' AS direction, 1 AS depth FROM fx_edges WHERE server IN (SELECT client FROM fx_edges x WHERE x.bundle_id = fx_edges.bundle_id) UNION ALL SELECT bundle_id, client, client, server, server, 'downstream', 1 FROM fx_edges", "fx_edges"))
add("a08_edge_rates", lambda s, d: topology.edge_rates(P.fx_edges(s, d)), oracle("SELECT client, server, round(r, 9) AS requests_per_second, round(f, 9) AS failures_per_second, round(CASE WHEN round(r, 9) > 0 THEN f / r ELSE 0 END, 6) AS error_ratio FROM (SELECT client, server, avg(requests_per_second) AS r, avg(failures_per_second) AS f FROM fx_edges GROUP BY ALL)", "fx_edges"))
add(
    "j02_requests_failures", lambda s, d: lookups.requests_with_failures(P.fx_edges(s, d).select("bundle_id", "client", "server", "requests_per_second"), P.fx_edges(s, d).filter("failures_per_second > 0.0001").select("bundle_id", "client", "server", "failures_per_second")),
    oracle("SELECT bundle_id, client, server, requests_per_second, CASE WHEN failures_per_second > 0.0001::DOUBLE THEN failures_per_second ELSE 0 END AS failures_per_second FROM fx_edges", "fx_edges"),
)
add("a22_counts", lambda s, d: _graph(s, d).groupBy("bundle_id").agg(F.count("*").alias("edges"), F.count_distinct("client").alias("clients"), F.count_distinct("server").alias("servers")), oracle("SELECT bundle_id, count(*) AS edges, count(DISTINCT client) AS clients, count(DISTINCT server) AS servers FROM g GROUP BY 1", "fx_edges", g=GRAPH))
add("a21_fingerprint", lambda s, d: grading.graph_fingerprint(P.fx_edges(s, d).select("bundle_id", "client", "server"), ["bundle_id"]), oracle("SELECT bundle_id, count(*) AS edges, CAST(sum(h) AS BIGINT) AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT bundle_id, ('0x' || substr(md5(client || '|' || server), 1, 12))::BIGINT AS h FROM fx_edges) GROUP BY 1", "fx_edges"))
add(
    "s17_upsert_edges", lambda s, d: governance.latest_window_edges(P.fx_edges(s, d).union(P.fx_edges(s, d).withColumn("requests_per_second", F.col("requests_per_second") * 2)), ["client", "server"], "bundle_id", [F.desc("requests_per_second")]).select("bundle_id", "client", "server", F.round("requests_per_second", 9).alias("requests_per_second")),
    oracle("SELECT bundle_id, client, server, round(requests_per_second * 2, 9) AS requests_per_second FROM fx_edges", "fx_edges"),
)
add("s18_windows", lambda s, d: governance.windows_of(P.fx_edges(s, d), "bundle_id"), oracle("SELECT DISTINCT bundle_id FROM fx_edges ORDER BY 1 DESC", "fx_edges"))


def _years(s, d, end):
    """The edges of the first or the last year that the table has."""
    edges = P.fx_edges(s, d)
    return edges.join(F.broadcast(edges.agg(end("bundle_id").alias("bundle_id"))), "bundle_id").select(F.concat_ws(">", "client", "server").alias("edge"))  # one row


add("u03_set_sizes", lambda s, d: lookups.set_sizes(_years(s, d, F.min), _years(s, d, F.max)),
    oracle("SELECT count(*) FILTER (t IS NOT NULL AND c IS NOT NULL) AS shared, count(*) FILTER (c IS NULL) AS only_treatment, count(*) FILTER (t IS NULL) AS only_control FROM (SELECT DISTINCT client || '>' || server AS t FROM fx_edges WHERE bundle_id = (SELECT min(bundle_id) FROM fx_edges)) FULL JOIN (SELECT DISTINCT client || '>' || server AS c FROM fx_edges WHERE bundle_id = (SELECT max(bundle_id) FROM fx_edges)) ON t = c", "fx_edges"))

# Traces


def _spans(s, d):
    """The spans, numbered and written once; paths read them several times."""
    return staged(P.fx_spans(s, d), "spans")


def _with_paths(s, d, of):
    spans = P.fx_spans(s, d, dealt=True)
    return of(spans, traces.critical_paths(spans, timed=True, dealt=True))


add("s02_scan_spans", lambda s, d: P.fx_spans(s, d).groupBy("service_name").agg(F.count("*").alias("spans")), oracle("SELECT service_name, count(*) AS spans FROM fx_spans GROUP BY 1", "fx_spans"))
add("p04_find_spans", lambda s, d: lookups.find_spans(P.fx_spans(s, d), "ERROR", 50.0, ["supp-1", "supp-2"]).select("trace_id", "span_id", "duration_ms"), oracle("SELECT trace_id, span_id, duration_ms FROM fx_spans WHERE status_code = 'ERROR' AND duration_ms >= 50 AND service_name IN ('supp-1', 'supp-2') ORDER BY duration_ms DESC, trace_id, span_id LIMIT 50", "fx_spans"))
add("p05_trace_spans", lambda s, d: lookups.trace_spans(P.fx_spans(s, d), 77), oracle("SELECT * FROM fx_spans WHERE trace_id = 77", "fx_spans"))
add("t04_slowest_traces", lambda s, d: lookups.slowest_traces(P.fx_spans(s, d)), oracle("SELECT trace_id, max(duration_ms) AS slowest_ms FROM fx_spans GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "fx_spans"))
PARENTS = "SELECT c.*, p.service_name AS parent_service FROM fx_spans c LEFT JOIN fx_spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id"
add("j03_parents", lambda s, d: topology.with_parents(P.fx_spans(s, d)).select("trace_id", "span_id", "parent_service"), oracle(f"SELECT trace_id, span_id, parent_service FROM ({PARENTS})", "fx_spans"))
PAIRS = f"SELECT trace_id, parent_service AS client, service_name AS server, start_time, duration_ms, status_code = 'ERROR' AS failed FROM ({PARENTS}) WHERE parent_service <> service_name"
add("j04_span_edges", lambda s, d: topology.span_edges(P.fx_spans(s, d)), oracle(PAIRS, "fx_spans"))
add("a11_span_topology", lambda s, d: topology.span_topology(P.fx_spans(s, d), 86_400.0), oracle(f"SELECT client, server, round(count(*) / 86400.0::DOUBLE, 9) AS requests_per_second, round(count(*) FILTER (failed) / 86400.0::DOUBLE, 9) AS failures_per_second FROM ({PAIRS}) GROUP BY ALL", "fx_spans"))
add("a10_red", lambda s, d: topology.red(P.fx_spans(s, d), 604_800).withColumns({c: F.round(c, 8) for c in ("rate", "p50_ms", "p95_ms")}), oracle("SELECT time_bucket(INTERVAL 7 DAYS, start_time, TIMESTAMP '1970-01-01') AS window_start, service_name, status_code, round(count(*) / 604800.0::DOUBLE, 8) AS rate, round(quantile_cont(duration_ms, 0.5), 8) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 8) AS p95_ms FROM fx_spans GROUP BY ALL", "fx_spans"))
add("x07_service_signals", lambda s, d: topology.service_signals(P.fx_spans(s, d)), oracle("SELECT service_name, count(*) AS spans, count(*) FILTER (status_code = 'ERROR') AS error_spans, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM fx_spans GROUP BY 1", "fx_spans"))
ROOTS = "SELECT * FROM fx_spans c WHERE parent_span_id IS NULL OR NOT EXISTS (SELECT 1 FROM fx_spans p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)"
add("x01_roots", lambda s, d: traces.roots(P.fx_spans(s, d)).select("trace_id", "span_id"), oracle(f"SELECT trace_id, span_id FROM ({ROOTS})", "fx_spans"))
BEST = "SELECT trace_id, parent_span_id AS parent, max((duration_ms, span_id, service_name, span_name)) AS b FROM fx_spans WHERE parent_span_id IS NOT NULL GROUP BY ALL"
PATHS = f"SELECT trace_id, max((duration_ms, span_id, service_name, span_name)) AS b, 0 AS hop FROM ({ROOTS}) GROUP BY 1 UNION ALL SELECT p.trace_id, best.b, hop + 1 FROM path p JOIN best ON best.trace_id = p.trace_id AND best.parent = p.b[2] WHERE hop < 40"
HOPS = "SELECT trace_id, hop, b[1] AS duration_ms, b[2] AS span_id, b[3] AS service_name, b[4] AS span_name FROM path"
add("x02_critical_path", lambda s, d: traces.critical_paths(P.fx_spans(s, d, dealt=True), dealt=True), oracle("SELECT * FROM hops", "fx_spans", best=BEST, path=PATHS, hops=HOPS))
SELF = "SELECT s.trace_id, s.span_id, s.service_name, s.duration_ms, greatest(s.duration_ms - coalesce(h, 0), 0) AS self_ms FROM fx_spans s LEFT JOIN (SELECT trace_id, parent_span_id AS span_id, sum(duration_ms) AS h FROM fx_spans GROUP BY ALL) USING (trace_id, span_id)"
add("x03_self_time", lambda s, d: traces.self_times(P.fx_spans(s, d)).withColumn("self_ms", F.round("self_ms", 6)), oracle(f"SELECT trace_id, span_id, service_name, duration_ms, round(self_ms, 6) AS self_ms FROM ({SELF})", "fx_spans"))
add(
    "x04_breakdown", lambda s, d: _with_paths(s, d, traces.breakdown),
    oracle("SELECT trace_id, hops, path_self_ms, slowest_service, slowest_self_ms, coalesce(error_spans, 0) AS error_spans FROM (SELECT trace_id, count(*) AS hops, round(sum(self_ms), 6) AS path_self_ms, max_by(h.service_name, (self_ms, span_id)) AS slowest_service, round(max(self_ms), 6) AS slowest_self_ms FROM hops h JOIN self_ USING (trace_id, span_id) GROUP BY 1) LEFT JOIN (SELECT trace_id, count(*) AS error_spans FROM fx_spans WHERE status_code = 'ERROR' GROUP BY 1) USING (trace_id)", "fx_spans", best=BEST, path=PATHS, hops=HOPS, self_=SELF),
)
add("x04_path_rows", lambda s, d: _with_paths(s, d, traces.path_rows).withColumn("self_ms", F.round("self_ms", 6)),
    oracle("SELECT h.trace_id, hop, span_id, h.service_name, h.span_name, h.duration_ms, round(self_ms, 6) AS self_ms FROM hops h JOIN self_ USING (trace_id, span_id)", "fx_spans", best=BEST, path=PATHS, hops=HOPS, self_=SELF))
add("x04_error_spans", lambda s, d: traces.error_rows(P.fx_spans(s, d)),
    oracle("SELECT trace_id, span_id, service_name, span_name, duration_ms, place FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS place FROM fx_spans WHERE status_code = 'ERROR') WHERE place <= 20", "fx_spans"))
TEXT = "SELECT trace_id, string_agg(service_name || ':' || span_name, ' -> ' ORDER BY hop) || ' (' || CAST(round(max_by(duration_ms, (duration_ms, -hop))) AS BIGINT) || 'ms slowest: ' || max_by(service_name, (duration_ms, -hop)) || ')' AS path FROM hops GROUP BY 1"
add("x06_path_text", lambda s, d: traces.path_text(traces.critical_paths(P.fx_spans(s, d, dealt=True), dealt=True, gathered=True)), oracle(TEXT, "fx_spans", best=BEST, path=PATHS, hops=HOPS))
add(
    "x05_find_traces", lambda s, d: traces.find_traces(_spans(s, d), "ERROR"),
    oracle(f"SELECT t.trace_id, slowest_ms, x.path, has_error, root_ms FROM (SELECT trace_id, max(duration_ms) AS slowest_ms FROM fx_spans WHERE status_code = 'ERROR' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t JOIN ({TEXT}) x USING (trace_id) JOIN (SELECT trace_id, bool_or(status_code = 'ERROR') AS has_error FROM fx_spans GROUP BY 1) USING (trace_id) JOIN (SELECT trace_id, duration_ms AS root_ms FROM hops WHERE hop = 0) USING (trace_id)", "fx_spans", best=BEST, path=PATHS, hops=HOPS),
)
add("w09_budget", lambda s, d: governance.budget_stops(P.fx_calls(s, d), "conv_id", {"calls": 5, "tokens": 900}), oracle("SELECT conv_id, min(round) AS round, min_by(l, round) AS limit_ FROM (SELECT conv_id, round, CASE WHEN row_number() OVER w >= 5 THEN 'calls' WHEN sum(tokens) OVER w >= 900 THEN 'tokens' END AS l FROM fx_calls WINDOW w AS (PARTITION BY conv_id ORDER BY round)) WHERE l IS NOT NULL GROUP BY 1", "fx_calls").replace("limit_", '"limit"'))
