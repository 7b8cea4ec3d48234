"""Roots, critical paths and self times of all traces at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakelens.sources.staging import staged

MAX_HOPS, HOPS = 40, 5
ERROR_SPANS = 20  # fixed value


def roots(spans: DataFrame) -> DataFrame:
    """Spans without a parent in their trace."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    lost = spans.filter("parent_span_id is not null").join(ids, ["trace_id", "parent_span_id"], "left_anti").select(*spans.columns)
    return spans.filter("parent_span_id is null").unionByName(lost)


def _best_children(spans: DataFrame, timed: bool, dealt: bool) -> DataFrame:
    """The child of the largest (duration, span id) of each node that spans name as their parent, and whether it exists.

    A span counts as a node and as its parent's child, so that one grouping tells both; spans of nodes that don't exist are
    roots. Spans are dealt by trace once, and everything that follows within traces stays where it is. `timed` adds what the
    children took together and, where spans repeat, the durations of all spans of a node's id.
    """
    child = F.struct("duration_ms", "span_id", "service_name", "span_name")
    own = F.struct("duration_ms")
    as_node = F.struct(F.col("span_id").alias("node"), F.lit(None).alias("child"), *([own.alias("own")] if timed else []))
    as_child = F.struct(F.col("parent_span_id").alias("node"), child.alias("child"), *([F.lit(None).alias("own")] if timed else []))
    sides = (spans if dealt else spans.repartition("trace_id")).select("trace_id", F.inline(F.array(as_node, as_child)))
    exists = F.bool_or(F.col("child").isNull() & F.col("node").isNotNull() & F.col("trace_id").isNotNull())
    found = sides.groupBy("trace_id", "node").agg(exists.alias("known"), F.max("child").alias("child"), *([F.sum("child.duration_ms").alias("held"), F.collect_list("own").alias("own")] if timed else []))
    if not timed:
        return found.filter("child is not null")
    return found.withColumn("own", F.when(F.col("known") & (F.size("own") > 1), F.col("own"))).filter("child is not null or own is not null")


def critical_paths(spans: DataFrame, max_hops: int = MAX_HOPS, timed: bool = False, dealt: bool = False, gathered: bool = False) -> DataFrame:
    """From each trace's longest root, the longest child again and again; a row for each hop of each trace.

    A round follows HOPS hops by windows over traces, which need no further shuffle; only longer paths go to the next one.
    `timed` adds the self times of the spans of each hop's id (`selves`: one, unless spans repeat), which the step to the
    next hop meets anyway. `dealt`: the spans lie by trace already. `gathered` gives a round's hops of a trace as one row with
    an array (`path`, at most HOPS + 1 hops), and whether they are the whole path.
    """
    trace = Window.partitionBy("trace_id")
    best = _best_children(spans.select("trace_id", "span_id", "parent_span_id", "service_name", "span_name", "duration_ms"), timed, dealt)
    root = F.max(F.when(~F.col("known"), F.col("child"))).over(trace)
    # Of a trace's nodes that don't exist only one has the root, unless spans repeat: then the smallest node.
    open_ = best.withColumn("tip", root).withColumn("start", F.min(F.when(~F.col("known") & (F.col("child") == F.col("tip")), F.struct(F.coalesce("node", F.lit("")).alias("name"), F.col("node").isNull().alias("no_node")))).over(trace))
    own = F.struct(F.coalesce("node", F.lit("")).alias("name"), F.col("node").isNull().alias("no_node"))
    first = ~F.col("known") & (F.col("child") == F.col("tip")) & (own == F.col("start"))
    open_ = open_.withColumn("hops", F.when(first, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).withColumn("tip", F.col("tip.span_id")).drop("start")
    here, at_tip = F.col("node") == F.col("tip"), ["held", "own"] if timed else []
    none = F.array().cast("array<struct<held:double,own:array<struct<duration_ms:double>>>>")

    def met(df: DataFrame, *child) -> DataFrame:
        """The tip's node, of which each trace has one at most; the row of the hop to it keeps what its children took."""
        df = df.withColumn("next", F.max(F.when(here, F.struct(*child, *at_tip))).over(trace))
        if not timed:
            return df
        return df.withColumn("selves", F.when(F.size("hops") > F.size("selves"), F.array_append("selves", F.struct("next.held", "next.own"))).otherwise(F.col("selves")))

    found, hop = None, 0
    while True:
        begin = hop + 1 if hop else 0
        if timed:
            open_ = open_.withColumn("selves", none)
        for _ in range(min(HOPS, max_hops - hop)):
            hop += 1
            open_ = met(open_, F.col("child.span_id").alias("id"))
            open_ = open_.withColumn("hops", F.when(here & F.col("child").isNotNull(), F.array_append("hops", F.lit(hop))).otherwise(F.col("hops"))).withColumn("tip", F.col("next.id")).drop("next")
        if timed:
            open_ = met(open_).drop("next")
        followed = {c: F.when(F.col("tip").isNotNull(), F.col(c)) for c in ("node", *at_tip, *(["child"] if gathered else []))}  # ended paths need only their hops
        if gathered:
            hops_of = F.collect_list(F.when(F.size("hops") > 0, F.struct("hops", "child"))).over(trace)
            hops_of = F.flatten(F.transform(hops_of, lambda x: F.transform(x["hops"], lambda h: F.struct(h.alias("hop"), *(x["child"][c].alias(c) for c in ("duration_ms", "service_name", "span_name"))))))
            open_ = open_.withColumn("path", hops_of).withColumn("path", F.when(F.get("hops", F.lit(0)) == begin, F.col("path")))
        level = staged(open_.filter("tip is not null or size(hops) > 0").withColumns(followed), "path")
        if timed:
            spans_of = F.coalesce("at.selves.own", F.array(F.struct("duration_ms")))
            selves = F.transform(spans_of, lambda x: F.greatest(x["duration_ms"] - F.coalesce("at.selves.held", F.lit(0.0)), F.lit(0.0)))
            rows = level.select("trace_id", "child.*", F.explode(F.arrays_zip("hops", "selves")).alias("at")).select("trace_id", "duration_ms", "span_id", "service_name", "span_name", F.col("at.hops").alias("hop"), selves.alias("selves"))
        elif gathered:
            ended = F.lit(True) if hop >= max_hops else F.expr("tip is null or trace_id is null")
            rows = level.filter("path is not null").select("trace_id", "path", (ended & F.lit(begin == 0)).alias("whole"))
        else:
            rows = level.select("trace_id", "child.*", F.explode("hops").alias("hop"))
        found = rows if found is None else found.unionByName(rows)
        more = level.filter("tip is not null and trace_id is not null")
        if hop >= max_hops or more.isEmpty():
            return found
        open_ = more.drop("path").repartition("trace_id").withColumn("hops", F.array().cast("array<int>"))


def self_times(spans: DataFrame) -> DataFrame:
    """A span's own time without its direct children's, at least 0."""
    held = spans.filter("parent_span_id is not null").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum("duration_ms").alias("held"))
    own = spans.join(held, ["trace_id", "span_id"], "left")
    return own.select("trace_id", "span_id", "service_name", "duration_ms", F.greatest(F.col("duration_ms") - F.coalesce("held", F.lit(0.0)), F.lit(0.0)).alias("self_ms"))


def path_rows(spans: DataFrame, paths: DataFrame) -> DataFrame:
    """The hops of each trace's critical path with their self times, which timed paths bring with them."""
    if "selves" in paths.columns:
        timed = paths.filter("trace_id is not null and span_id is not null").withColumn("self_ms", F.explode("selves"))
    else:
        timed = paths.join(self_times(spans).select("trace_id", "span_id", "self_ms"), ["trace_id", "span_id"])
    return timed.select("trace_id", "hop", "span_id", "service_name", "span_name", "duration_ms", "self_ms")


def error_rows(spans: DataFrame, limit: int = ERROR_SPANS) -> DataFrame:
    """The first error spans of each trace."""
    order = Window.partitionBy("trace_id").orderBy("start_time", "span_id")
    found = spans.filter("status_code = 'ERROR'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return found.select("trace_id", "span_id", "service_name", "span_name", "duration_ms", "place")


def breakdown(spans: DataFrame, paths: DataFrame) -> DataFrame:
    """Each trace's path length, total and slowest self time on it, and the number of its error spans."""
    timed = path_rows(spans, paths)
    path = timed.groupBy("trace_id").agg(
        F.count("*").alias("hops"), F.round(F.sum("self_ms"), 6).alias("path_self_ms"), F.max_by("service_name", F.struct("self_ms", "span_id")).alias("slowest_service"), F.round(F.max("self_ms"), 6).alias("slowest_self_ms")
    )
    errors = spans.filter("status_code = 'ERROR'").groupBy("trace_id").agg(F.count("*").alias("error_spans"))
    return path.join(errors, "trace_id", "left").withColumn("error_spans", F.coalesce("error_spans", F.lit(0)))


def path_text(paths: DataFrame) -> DataFrame:
    """Service:span hops in order, with the slowest of them; gathered paths are grouped only where they took several rounds."""
    if "path" in paths.columns:
        longer = paths.filter("not whole").groupBy("trace_id").agg(F.flatten(F.collect_list("path")).alias("path"))  # at most MAX_HOPS of a trace
        whole = paths.filter("whole").select("trace_id", "path").unionByName(longer)
    else:
        whole = paths.groupBy("trace_id").agg(F.collect_list(F.struct("hop", "duration_ms", "service_name", "span_name")).alias("path"))
    texts = F.transform(F.array_sort("path"), lambda x: F.concat(x["service_name"], F.lit(":"), x["span_name"]))
    slowest = F.array_max(F.transform("path", lambda x: F.struct(x["duration_ms"].alias("duration_ms"), (-x["hop"]).alias("place"), x["service_name"].alias("service_name"))))
    return whole.select("trace_id", texts.alias("hops"), slowest.alias("s")).select(
        "trace_id", F.concat(F.array_join("hops", " -> "), F.lit(" ("), F.round("s.duration_ms", 0).cast("long").cast("string"), F.lit("ms slowest: "), "s.service_name", F.lit(")")).alias("path")
    )


def find_traces(spans: DataFrame, status: str | None = None, limit: int = 10) -> DataFrame:
    """The traces of the slowest spans, with their paths, whether they failed, and their roots' durations."""
    wanted = spans if status is None else spans.filter(F.col("status_code") == status)
    top = wanted.groupBy("trace_id").agg(F.max("duration_ms").alias("slowest_ms")).orderBy(F.desc("slowest_ms"), "trace_id").limit(limit)
    whole = spans.join(F.broadcast(top.select("trace_id")), "trace_id", "left_semi")  # `limit` rows
    failed = whole.groupBy("trace_id").agg(F.bool_or(F.col("status_code") == "ERROR").alias("has_error"))
    paths = critical_paths(whole)
    root = paths.filter("hop = 0").select("trace_id", F.col("duration_ms").alias("root_ms"))
    return top.join(path_text(paths), "trace_id").join(failed, "trace_id").join(root, "trace_id")


def ranked_paths(paths: DataFrame) -> DataFrame:
    """Paths with each hop's rank by duration in its trace."""
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("duration_ms"), "hop")))
