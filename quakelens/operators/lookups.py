"""Look-up questions on facts: filters, sums of windows, joins to neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelens.functions import columns as C


def _within(column: str, start: str | None, end: str | None) -> Column:
    """A closed range, either side open where it is None; the column stays bare so that the filter reaches the scan."""
    found = F.lit(True)
    if start is not None:
        found = found & (F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        found = found & (F.col(column) <= F.lit(end).cast("timestamp"))
    return found


def query_metrics(facts: DataFrame, metric: str, start: str | None = None, end: str | None = None, services: list[str] | None = None, limit: int | None = 50) -> DataFrame:
    """A metric's samples in a window, by time and service."""
    found = facts.filter((F.col("metric_name") == metric) & _within("timestamp", start, end))
    if services:
        found = found.filter(F.col("service_name").isin(services))
    return found if limit is None else found.orderBy("timestamp", "service_name", "value").limit(limit)


def metric_series(facts: DataFrame, metric: str, start: str | None = None, end: str | None = None, cap: int | None = None) -> DataFrame:
    """Whole series; a cap, if any, takes whole services first."""
    found = query_metrics(facts, metric, start, end, None, None)
    return found if cap is None else found.orderBy("service_name", "timestamp", "value").limit(cap)


def search_logs(logs: DataFrame, pattern: str | None = None, severity: str | None = None, services: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = 50) -> DataFrame:
    """Newest lines that hold a literal text, upper or lower case."""
    found = logs.filter(_within("timestamp", start, end))
    if pattern is not None:
        found = found.filter(F.contains(F.lower("body"), F.lower(F.lit(pattern[:200]))))
    if severity is not None:
        found = found.filter(F.upper("severity") == severity.upper())
    if services:
        found = found.filter(F.col("service_name").isin(services))
    return found if limit is None else found.orderBy(F.desc("timestamp"), "service_name", "body").limit(limit)


def find_spans(spans: DataFrame, status: str | None = None, least_ms: float | None = None, services: list[str] | None = None, limit: int | None = 50) -> DataFrame:
    """Slowest spans first."""
    found = spans
    if status is not None:
        found = found.filter(F.col("status_code") == status)
    if least_ms is not None:
        found = found.filter(F.col("duration_ms") >= least_ms)
    if services:
        found = found.filter(F.col("service_name").isin(services))
    return found if limit is None else found.orderBy(F.desc("duration_ms"), "trace_id", "span_id").limit(limit)


def trace_spans(spans: DataFrame, trace_id: int | str) -> DataFrame:
    """P5: a whole trace, by start and span."""
    return spans.filter(F.col("trace_id") == trace_id).orderBy("start_time", "span_id")


def recent_changes(changes: DataFrame, start: str | None = None, end: str | None = None, services: list[str] | None = None) -> DataFrame:
    """Changes in a window, compared as times."""
    found = changes.filter(_within("at", start, end))
    return found.filter(F.col("service").isin(services)) if services else found


def errors_only(facts: DataFrame, path: str = "$.status_code", code: str = "STATUS_CODE_ERROR") -> DataFrame:
    """Samples whose labels carry the error status."""
    return facts.filter(F.get_json_object("labels_json", path) == code)


def known_services(facts: DataFrame) -> DataFrame:
    """The distinct services."""
    return facts.select("service_name").distinct()


def window_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Largest and smallest value and the number of samples."""
    return facts.groupBy(*keys).agg(F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.count("*").alias("samples"))


def signal_changed(before: DataFrame, after: DataFrame, keys: list[str], least: float = 0.2) -> DataFrame:
    """Signals (keys, value) that moved by more than a share; appearing counts, vanishing doesn't."""
    b, a = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    moved = F.abs(F.col("after") - F.col("before")) / F.abs("before") > least
    return b.join(a, keys, "full").withColumn(
        "changed", F.when(F.col("after").isNull(), False).when(F.col("before").isNull() | (F.col("before") == 0), F.coalesce(F.col("after") != 0, F.lit(False))).otherwise(moved)
    )


def requests_with_failures(requests: DataFrame, failures: DataFrame) -> DataFrame:
    """Requests by edge with their failures, 0 where there are none; unknown peers go."""
    known = (F.col("client") != "unknown") & (F.col("server") != "unknown")
    joined = requests.filter(known).join(failures, ["bundle_id", "client", "server"], "left")
    return joined.withColumn("failures_per_second", F.coalesce("failures_per_second", F.lit(0.0)))


def _slice(at: Column, width_us: int) -> Column:
    return F.floor(F.unix_micros(at) / width_us)


def first_alert_after(points: DataFrame, alerts: DataFrame, timeout_seconds: int, slices: int = 8) -> DataFrame:
    """The first alert of the same key at or after each point (key, point_id, at), within a timeout.

    Both sides are sorted together by time and the next alert is carried back to the points, so no point meets more than
    one alert. A key is cut into slices of time, as many to the timeout as `slices` says; a slice also gets the first alert
    of each slice that a point's timeout can reach. Of alerts at one time the smallest counts; rows without a key or a time
    find nothing.
    """
    width = max(1, -(-timeout_seconds * 1_000_000 // slices))
    told = alerts.filter("key is not null and at is not null").select("key", F.col("at").alias("time"), "alert").withColumn("slice", _slice(F.col("time"), width))
    firsts = told.groupBy("key", "slice").agg(F.min(F.struct("time", "alert")).alias("found"))
    reach = F.explode(F.sequence(F.lit(1), F.lit(slices)))
    carried = firsts.select("key", "found", "slice", reach.alias("back")).select("key", (F.col("slice") - F.col("back")).alias("slice"), "found")
    ours = points.select("key", "point_id", "at", _slice(F.col("at"), width).alias("slice"))
    both = ours.unionByName(told.select("key", "slice", F.struct("time", "alert").alias("found")).unionByName(carried), allowMissingColumns=True)
    both = both.withColumns({"is_alert": F.col("found").isNotNull(), "time": F.coalesce("found.time", "at")})
    # From the latest to the earliest, of one time the alerts first and of these the smallest last.
    back = Window.partitionBy("key", "slice").orderBy(F.desc("time"), F.desc("is_alert"), F.desc("found.alert")).rowsBetween(Window.unboundedPreceding, 0)
    next_ = both.withColumn("next", F.last("found", ignorenulls=True).over(back)).filter("not is_alert")
    soon = F.unix_micros("next.time") <= F.unix_micros("at") + timeout_seconds * 1_000_000
    return next_.select("key", "point_id", "at", F.when(soon, F.col("next.time")).alias("alert_at"), F.when(soon, F.col("next.alert")).alias("alert"))


def changes_near(onset_times: DataFrame, changes: DataFrame, before_seconds: int) -> DataFrame:
    """Changes of a service within some time before its onset (service, onset_at); nearness, not cause.

    Slices of time as long as the nearness meet: an onset's own slice and the one before. Rows made are those of the result
    and at most those of as much time again around it, whatever a service's history holds.
    """
    width = max(1, before_seconds * 1_000_000)
    own = _slice(F.col("onset_at"), width)
    sliced = onset_times.withColumn("__slice", F.explode(F.array(own, own - 1)))
    near = sliced.join(changes.withColumn("__slice", _slice(F.col("at"), width)), ["service", "__slice"]).drop("__slice")
    near = near.filter((F.col("at") <= F.col("onset_at")) & (F.unix_micros("at") >= F.unix_micros("onset_at") - before_seconds * 1_000_000))
    return near.withColumn("seconds_before", C.seconds_between(F.col("at"), F.col("onset_at")))


def slowest_traces(spans: DataFrame, limit: int = 10) -> DataFrame:
    """T4: distinct traces in the order of their slowest span."""
    return spans.groupBy("trace_id").agg(F.max("duration_ms").alias("slowest_ms")).orderBy(F.desc("slowest_ms"), "trace_id").limit(limit)


def membership(items: DataFrame, done: DataFrame, key: str, group: str) -> DataFrame:
    """Items by group, how many of them are done, and how many await it."""
    marked = items.join(done.select(key).distinct().withColumn("done", F.lit(True)), key, "left")
    return marked.groupBy(group).agg(F.count("*").alias("total"), F.count_if("done").alias("covered"), F.count_if(F.col("done").isNull()).alias("awaiting"))


def profiles(services: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Services with a sorted list for each kind of child (service, item); empty lists where there are none."""
    found = services
    for name, child in children.items():
        found = found.join(child.groupBy("service").agg(F.sort_array(F.collect_set("item")).alias(name)), "service", "left")
        found = found.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return found


def covering(documents: DataFrame, services: DataFrame) -> DataFrame:
    """Documents by the services that they cover."""
    return services.join(documents.withColumn("service", F.explode("covers")), "service")


def set_sizes(treatment: DataFrame, control: DataFrame) -> DataFrame:
    """How many keys two one-column tables share, and how many only one has."""
    key = treatment.columns[0]
    t, c = treatment.distinct().withColumn("t", F.lit(1)), control.distinct().withColumn("c", F.lit(1))
    both = t.join(c, key, "full")
    return both.agg(F.count_if(F.col("t").isNotNull() & F.col("c").isNotNull()).alias("shared"), F.count_if(F.col("c").isNull()).alias("only_treatment"), F.count_if(F.col("t").isNull()).alias("only_control"))


def field_differences(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Field by field, where two runs differ; rows of one run only differ in their presence."""
    fields = [c for c in first.columns if c != key]
    a, b = first.select(key, F.struct(*fields).alias("x")), second.select(key, F.struct(*fields).alias("y"))
    both = a.join(b, key, "full")
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("string").alias("first"), F.col(f"y.{f}").cast("string").alias("second")) for f in fields))
    return both.select(key, F.inline(rows)).filter(~F.col("first").eqNullSafe(F.col("second")))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row for each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
