"""Ranking causes over call graphs, for all bundles at once.

A graph is a table (bundle_id, client, server, weight); scores are tables (bundle_id, service, anomaly).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.sources.staging import importable, staged, staged_at

RESTART_ALPHA, SHARPNESS, ONSET_BONUS = 0.15, 1.0, 1.25  # fixed values
TOLERANCE, MAX_ROUNDS = 1e-8, 200
#: Nodes and edges of a bundle that is walked in one task, some tens of MB there.
GROUP_ROWS = 200_000
ABSTENTION = 22.717
EDGE = ["bundle_id", "client", "server"]


def call_graph(edges: DataFrame) -> DataFrame:
    """The traffic of each edge, repeated observations summed."""
    return edges.groupBy(*EDGE).agg(F.sum("requests_per_second").alias("weight"))


def graph_nodes(graph: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Every service that calls, is called or is scored."""
    ends = graph.select("bundle_id", F.explode(F.array("client", "server")).alias("service"))
    return ends.union(anomalies.select("bundle_id", "service")).distinct()


def with_backward_edges(graph: DataFrame, ratio: float = 0.0) -> DataFrame:
    """Each edge mirrored at a share of its weight."""
    if ratio <= 0:
        return graph
    back = graph.select("bundle_id", F.col("server").alias("client"), F.col("client").alias("server"), (F.col("weight") * ratio).alias("weight"))
    return graph.select(*EDGE, "weight").union(back).groupBy(*EDGE).agg(F.sum("weight").alias("weight"))


def with_self_loops(graph: DataFrame, nodes: DataFrame, ratio: float = 0.0) -> DataFrame:
    """A loop at each node, a share of its outflow; a leaf's has weight 1."""
    if ratio <= 0:
        return graph
    out = graph.groupBy("bundle_id", F.col("client").alias("service")).agg(F.sum("weight").alias("out"))
    loops = nodes.join(out, ["bundle_id", "service"], "left").select(
        "bundle_id", F.col("service").alias("client"), F.col("service").alias("server"), F.when(F.col("out") > 0, F.col("out") * ratio).otherwise(1.0).alias("weight")
    )
    return graph.select(*EDGE, "weight").union(loops).groupBy(*EDGE).agg(F.sum("weight").alias("weight"))


def scaled_by_endpoints(graph: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Weights times the square roots of one plus each end's anomaly."""
    ends = [anomalies.select("bundle_id", F.col("service").alias(e), F.col("anomaly").alias(f"a_{e}")) for e in ("client", "server")]
    joined = graph.join(ends[0], ["bundle_id", "client"], "left").join(ends[1], ["bundle_id", "server"], "left")
    root = lambda c: F.sqrt(1.0 + F.coalesce(F.col(c), F.lit(0.0)))
    return joined.select(*EDGE, (F.col("weight") * root("a_client") * root("a_server")).alias("weight"))


def restart_vector(nodes: DataFrame, anomalies: DataFrame, sharpness: float = SHARPNESS) -> DataFrame:
    """Anomalies as shares of their bundle's sum; equal shares where all are 0."""
    raw = nodes.join(anomalies, ["bundle_id", "service"], "left").withColumn("raw", F.pow(F.greatest(F.coalesce("anomaly", F.lit(0.0)), F.lit(0.0)), sharpness))
    of = Window.partitionBy("bundle_id")
    return raw.select("bundle_id", "service", F.when(F.sum("raw").over(of) > 0, F.col("raw") / F.sum("raw").over(of)).otherwise(1.0 / F.count("*").over(of)).alias("restart"))


def _parts(graph: DataFrame, restart: DataFrame, damping: float) -> tuple[DataFrame, DataFrame]:
    """What each node passes along its edges, and each node's restart share and whether it has no outgoing weight; both written."""
    own = restart.withColumnRenamed("restart", "share")
    out = graph.groupBy("bundle_id", F.col("client").alias("service")).agg(F.sum("weight").alias("out")).filter("out > 0")
    moves = graph.filter("weight > 0").join(out.withColumnRenamed("service", "client"), ["bundle_id", "client"]).select("bundle_id", F.col("client").alias("service"), "server", (damping * F.col("weight") / F.col("out")).alias("p"))
    leaves = own.join(out, ["bundle_id", "service"], "left_anti").select("bundle_id", "service").withColumn("leaf", F.lit(True))
    base = own.join(leaves, ["bundle_id", "service"], "left").select("bundle_id", "service", "share", F.coalesce("leaf", F.lit(False)).alias("leaf"))
    return staged(moves, "moves"), staged(base, "restart")


def _round(ranks: DataFrame, moves: DataFrame, damping: float) -> DataFrame:
    """One round from written ranks (bundle_id, service, share, leaf, rank), with what each rank was `before`.

    What leaves lose is a row for each bundle; what nodes get is summed before and after the shuffle, so a service that
    many call is no hot key.
    """
    lost = ranks.filter("leaf").groupBy("bundle_id").agg(F.sum("rank").alias("lost"))
    sent = ranks.join(moves, ["bundle_id", "service"]).groupBy("bundle_id", F.col("server").alias("service")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
    fixed = (damping * F.coalesce("lost", F.lit(0.0)) + 1 - damping) * F.col("share")
    return ranks.join(lost, "bundle_id", "left").join(sent, ["bundle_id", "service"], "left").select(
        "bundle_id", "service", "share", "leaf", F.col("rank").alias("before"), (fixed + F.coalesce("got", F.lit(0.0))).alias("rank")
    )


def pagerank_rounds(graph: DataFrame, restart: DataFrame, rounds: int, damping: float = 1 - RESTART_ALPHA) -> DataFrame:
    """G6 for graphs of any size: a number of rounds as joins and sums, each written.

    A node without outgoing weight passes its rank to all nodes by their restart shares.
    """
    moves, base = _parts(graph, restart, damping)
    ranks = base.withColumn("rank", F.col("share"))
    for _ in range(rounds):
        ranks = staged(_round(ranks, moves, damping).drop("before"), "ranks")
    return ranks.select("bundle_id", "service", F.col("rank").alias("graph_score"))


def pagerank_settled(graph: DataFrame, restart: DataFrame, damping: float = 1 - RESTART_ALPHA, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """G6 to convergence for graphs of any size: rounds as joins and sums until no bundle's ranks move by the tolerance in all.

    A bundle whose ranks have settled is put by and takes no part in further rounds.
    """
    moves, base = _parts(graph, restart, damping)
    ranks = base.withColumn("rank", F.col("share"))
    done: list[str] = []
    scored = "bundle_id string, service string, graph_score double"
    for _ in range(max_rounds):
        ranks = staged(_round(ranks, moves, damping), "ranks")
        moved = ranks.groupBy("bundle_id").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("moved"))
        settled = moved.filter(F.col("moved") < tolerance).select("bundle_id")
        found = ranks.join(settled, "bundle_id", "left_semi").select(F.col("bundle_id").cast("string"), "service", F.col("rank").alias("graph_score"))
        open_ = ranks.join(settled, "bundle_id", "left_anti").drop("before")
        at = moved.agg(F.count("*").alias("all"), F.count_if(F.col("moved") < tolerance).alias("settled")).first()
        if at["settled"]:
            done.append(staged_at(found, "settled"))
        if at["settled"] == at["all"]:
            return graph.sparkSession.read.schema(scored).parquet(*done) if done else graph.sparkSession.createDataFrame([], scored)
        ranks = staged(open_, "ranks") if at["settled"] else ranks.drop("before")
    raise ArithmeticError(f"ranks did not settle in {max_rounds} rounds")


def _walk(damping: float, tolerance: float, max_rounds: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, graph: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("service", ignore_index=True)
        place = {s: i for i, s in enumerate(nodes["service"])}
        graph = graph[graph["weight"] > 0].sort_values(["client", "server"])
        start, end, weight = graph["client"].map(place).to_numpy(), graph["server"].map(place).to_numpy(), graph["weight"].to_numpy()
        n, restart = len(nodes), nodes["restart"].to_numpy()
        out = np.bincount(start, weight, n) if len(graph) else np.zeros(n)
        share = weight / out[start] if len(graph) else weight
        rank = restart.copy()
        for _ in range(max_rounds):
            got = np.bincount(end, rank[start] * share, n) if len(graph) else np.zeros(n)
            new = damping * got + (damping * rank[out <= 0].sum() + 1 - damping) * restart
            done, rank = np.abs(new - rank).sum() < tolerance, new
            if done:
                return pd.DataFrame({"bundle_id": key[0], "service": nodes["service"], "graph_score": rank})
        raise ArithmeticError(f"ranks of {key[0]} did not settle in {max_rounds} rounds")

    return run


def pagerank(
    graph: DataFrame, restart: DataFrame, damping: float = 1 - RESTART_ALPHA, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """G6 to convergence. A bundle of at most `group_rows` nodes and edges is walked in one group, a larger one by joins and sums."""
    importable(graph.sparkSession)
    graph, restart = staged(graph.select(*EDGE, "weight"), "graph"), staged(restart.select("bundle_id", "service", "restart"), "shares")
    sizes = graph.select("bundle_id").unionByName(restart.select("bundle_id")).groupBy("bundle_id").agg(F.count("*").alias("rows"))
    large = staged(sizes.filter(F.col("rows") > group_rows).select("bundle_id"), "large-bundles")
    some = not large.isEmpty()
    small = [x.join(large, "bundle_id", "left_anti") if some else x for x in (graph, restart)]
    found = small[0].groupBy("bundle_id").cogroup(small[1].groupBy("bundle_id")).applyInPandas(_walk(damping, tolerance, max_rounds), "bundle_id string, service string, graph_score double")
    if not some:
        return found
    return found.unionByName(pagerank_settled(*(x.join(large, "bundle_id", "left_semi") for x in (graph, restart)), damping, tolerance, max_rounds))


def rank_candidates(
    edges: DataFrame, anomalies: DataFrame, onset_times: DataFrame | None = None, alpha: float = RESTART_ALPHA, sharpness: float = SHARPNESS, scaling: bool = True,
    bonus: float = ONSET_BONUS, loops: float = 0.0, backward: float = 0.0, rounds: int | None = None,
) -> DataFrame:
    """Candidates of each bundle by graph score, times a bonus for the earliest onset; ties by name."""
    graph = call_graph(edges)
    nodes = graph_nodes(graph, anomalies)
    walked = with_backward_edges(graph, backward)
    if scaling:
        walked = scaled_by_endpoints(walked, anomalies)
    walked = with_self_loops(walked, nodes, loops)
    restart = restart_vector(nodes, anomalies, sharpness)
    scores = pagerank(walked, restart, 1 - alpha) if rounds is None else pagerank_rounds(walked, restart, rounds, 1 - alpha)
    found = scores.join(anomalies, ["bundle_id", "service"], "left")
    if onset_times is None:
        found = found.withColumn("onset_seconds", F.lit(None).cast("double"))
    else:
        found = found.join(onset_times.select("bundle_id", F.col("service_name").alias("service"), "onset_seconds"), ["bundle_id", "service"], "left")
    earliest = F.min("onset_seconds").over(Window.partitionBy("bundle_id"))
    first = F.coalesce(F.col("onset_seconds") <= earliest, F.lit(False))
    found = found.select(
        "bundle_id", "service", F.round(F.col("graph_score") * F.when(first, bonus).otherwise(1.0), 10).alias("score"), F.round(F.coalesce("anomaly", F.lit(0.0)), 4).alias("anomaly_score"),
        F.round("graph_score", 10).alias("graph_score"), "onset_seconds", first.alias("started_first"),
    )
    return found.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"), "service")))


def rank_under_settings(edges: DataFrame, anomalies: DataFrame, settings: DataFrame, onset_times: DataFrame | None = None) -> DataFrame:
    """G7 under many settings at once: candidates by configuration and bundle, in one walk over all of them.

    settings: a row for each configuration with scaling (boolean), loops, backward, sharpness and bonus. Edges and scores are
    summed once; then every key has the configuration in it, and each step takes its parameters from the row.
    """
    keys = ["configuration", "scaling", "loops", "backward", "sharpness", "bonus"]
    listed = F.broadcast(settings.agg(F.collect_list(F.struct(*keys)).alias("all")))  # one row
    under = lambda df: df.crossJoin(listed).select("*", F.inline("all")).drop("all").withColumns({"of": F.col("bundle_id"), "bundle_id": F.concat("configuration", F.lit("\0"), "bundle_id")})
    base = call_graph(edges)
    nodes = staged(under(graph_nodes(base, anomalies).join(anomalies, ["bundle_id", "service"], "left")), "settings-nodes")
    graph = under(base)
    back = graph.filter("backward > 0").select(F.col("server").alias("client"), F.col("client").alias("server"), (F.col("weight") * F.col("backward")).alias("weight"), "bundle_id", "scaling")
    both = graph.select("client", "server", "weight", "bundle_id", "scaling").unionByName(back).groupBy(*EDGE, "scaling").agg(F.sum("weight").alias("weight"))
    ends = [nodes.select("bundle_id", F.col("service").alias(e), F.col("anomaly").alias(f"a_{e}")) for e in ("client", "server")]
    root = lambda c: F.sqrt(1.0 + F.coalesce(F.col(c), F.lit(0.0)))
    weight = F.when(F.col("scaling"), F.col("weight") * root("a_client") * root("a_server")).otherwise(F.col("weight"))
    walked = staged(both.join(ends[0], ["bundle_id", "client"], "left").join(ends[1], ["bundle_id", "server"], "left").select(*EDGE, weight.alias("weight")), "settings-graph")
    out = walked.groupBy("bundle_id", F.col("client").alias("service")).agg(F.sum("weight").alias("out"))
    loops = nodes.filter("loops > 0").join(out, ["bundle_id", "service"], "left").select(
        "bundle_id", F.col("service").alias("client"), F.col("service").alias("server"), F.when(F.col("out") > 0, F.col("out") * F.col("loops")).otherwise(1.0).alias("weight")
    )
    walked = walked.unionByName(loops).groupBy(*EDGE).agg(F.sum("weight").alias("weight"))
    raw = F.pow(F.greatest(F.coalesce("anomaly", F.lit(0.0)), F.lit(0.0)), F.col("sharpness"))
    sums = nodes.groupBy("bundle_id").agg(F.sum(raw).alias("whole"), F.count("*").alias("n"))
    restart = nodes.join(sums, "bundle_id").select("bundle_id", "service", F.when(F.col("whole") > 0, raw / F.col("whole")).otherwise(1.0 / F.col("n")).alias("restart"))
    found = pagerank(walked, restart).join(nodes, ["bundle_id", "service"])
    onset = F.lit(None).cast("double").alias("onset_seconds")
    if onset_times is None:
        found = found.withColumn("onset_seconds", onset)
    else:
        found = found.join(onset_times.select(F.col("bundle_id").alias("of"), F.col("service_name").alias("service"), "onset_seconds"), ["of", "service"], "left")
    first = F.coalesce(F.col("onset_seconds") <= F.min("onset_seconds").over(Window.partitionBy("bundle_id")), F.lit(False))
    scored = found.withColumn("score", F.round(F.col("graph_score") * F.when(first, F.col("bonus")).otherwise(1.0), 10))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"), "service")))
    return placed.select("configuration", F.col("of").alias("bundle_id"), "service", "score", "place")


def confidence(candidates: DataFrame) -> DataFrame:
    """The first candidate of each bundle and how far it stands from the second, by raw graph scores."""
    two = candidates.filter("place <= 2").groupBy("bundle_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("service"))).alias("service"), F.max(F.when(F.col("place") == 1, F.col("graph_score"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("graph_score"))).alias("runner_up")
    )
    return two.select("bundle_id", "service", C.confidence_from_ratio(F.col("top"), F.col("runner_up")).alias("confidence"))


def abstained(found: DataFrame, tops: DataFrame, threshold: float = ABSTENTION) -> DataFrame:
    """No service and no confidence where the bundle's top anomaly (bundle_id, top_anomaly) is under the threshold."""
    quiet = F.coalesce("top_anomaly", F.lit(0.0)) < threshold
    return found.join(tops, "bundle_id", "left").select(
        "bundle_id", F.coalesce("top_anomaly", F.lit(0.0)).alias("top_anomaly"), quiet.alias("abstained"), F.when(~quiet, F.col("service")).alias("root_cause"), F.when(~quiet, F.col("confidence")).alias("confidence")
    )


def dependencies(edges: DataFrame, starts: DataFrame, direction: str = "downstream", depth: int = 3) -> DataFrame:
    """From each start (bundle_id, start), a row for each edge that reaches a service new at its level."""
    near, far = ("client", "server") if direction == "downstream" else ("server", "client")
    hops = edges.select("bundle_id", F.col(near).alias("service"), F.col(far).alias("neighbour"), "client", "server").distinct()
    hops = staged(hops, "hops")  # read again at each level
    frontier = starts.select("bundle_id", "start", F.col("start").alias("service"))
    visited, found = frontier, None
    for level in range(1, depth + 1):
        reached = frontier.join(hops, ["bundle_id", "service"]).join(visited.withColumnRenamed("service", "neighbour"), ["bundle_id", "start", "neighbour"], "left_anti")
        rows = reached.select("bundle_id", "start", "client", "server", "neighbour", F.lit(direction).alias("direction"), F.lit(level).alias("depth"))
        rows = staged(rows, "reached")
        found = rows if found is None else found.unionByName(rows)
        frontier = rows.select("bundle_id", "start", F.col("neighbour").alias("service")).distinct()
        visited = visited.union(frontier)
    return found


def both_directions(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Upstream rows and downstream rows."""
    return dependencies(edges, starts, "upstream", depth).unionByName(dependencies(edges, starts, "downstream", depth))


def reachable(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """The smallest depth at which each service is reached downstream, up to a depth."""
    return dependencies(edges, starts, "downstream", depth).groupBy("bundle_id", "start", F.col("neighbour").alias("service")).agg(F.min("depth").alias("depth"))


def blast_radius(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All transitive callers of each start, at any depth, by the level at which they are met first."""
    hops = edges.select("bundle_id", F.col("server").alias("service"), F.col("client").alias("caller")).distinct()
    hops = staged(hops, "hops")  # read again at each level
    frontier = starts.select("bundle_id", "start", F.col("start").alias("service"))
    visited, level = frontier.withColumn("level", F.lit(0)), 0
    while True:
        level += 1
        new = frontier.join(hops, ["bundle_id", "service"]).select("bundle_id", "start", F.col("caller").alias("service")).distinct()
        new = staged(new.join(visited, ["bundle_id", "start", "service"], "left_anti"), "callers")
        if new.isEmpty():
            return visited.filter("level > 0")
        visited = visited.unionByName(new.withColumn("level", F.lit(level)))
        frontier = new
