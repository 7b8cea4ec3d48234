"""Streams against their batch twins; a row far in the future pushes the watermark past all windows."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quakelens.streaming import alerts, rollups, watch
from quakelens.streaming.totals import Totals

T0 = datetime(2024, 1, 1)


def run(spark, stream, tmp_path, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def source(spark, rows, schema, tmp_path, files=3):
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "in")
    for i in range(files):
        df.filter(F.pmod(F.monotonically_increasing_id(), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_red_and_late_rows(spark, tmp_path):
    rows = [(f"s{i % 2}", "ERROR" if i % 3 == 0 else "OK", T0 + timedelta(seconds=5 * i), float(i)) for i in range(40)]
    far = ("s0", "OK", T0 + timedelta(days=1), 1.0)
    df, stream = source(spark, [*rows, far], "service_name string, status_code string, start_time timestamp, duration_ms double", tmp_path, 1)
    want = {tuple(r) for r in rollups.red(df).collect() if r.window_start < far[2]}
    assert {tuple(r) for r in run(spark, rollups.red(stream), tmp_path, "red").collect()} == want


def test_hold(spark, tmp_path):
    firing = [1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 1]
    rows = [("r", "s", T0 + timedelta(seconds=30 * i), bool(f)) for i, f in enumerate(firing)]
    df, stream = source(spark, rows, "rule string, service_name string, at timestamp, firing boolean", tmp_path, 1)
    assert [r.fired_at for r in alerts.held(df, 120).collect()] == [rows[8][2]]
    assert [r.fired_at for r in run(spark, alerts.held_stream(stream, 120), tmp_path, "held").collect()] == [rows[8][2]]


def test_recovery_and_first_crossing(spark, tmp_path):
    values = [9.0, 1.0, None, 1.0, 9.0, 1.0, 1.0, 1.0]
    rows = [("w", T0 + timedelta(seconds=15 * i), v, 1.0, T0) for i, v in enumerate(values)]
    rows.append(("w", T0 + timedelta(seconds=200), None, 1.0, T0))  # readings count once the watermark has passed them
    _, stream = source(spark, rows, "watch string, at timestamp, value double, baseline double, acted_at timestamp", tmp_path, 1)
    (r,) = run(spark, watch.recovery_watch(stream), tmp_path, "recovery").collect()
    assert (r.status, r.after_seconds) == ("recovered", 105.0)


def in_batches(spark, batches, schema, tmp_path, name, transform):
    """The stream's rows when each list of rows comes in a batch of its own."""
    path = tmp_path / f"in-{name}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        found = run_again(spark, transform(spark.readStream.schema(schema).parquet(str(path))), tmp_path, name)
    return found


def run_again(spark, stream, tmp_path, name):
    out, checkpoint = str(tmp_path / f"out-{name}"), str(tmp_path / f"c-{name}")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_hold_of_late_samples(spark, tmp_path):
    """A break that comes late, but before the watermark, counts where it belongs; a firing alert is resolved."""
    at = lambda i, f: ("r", "s", T0 + timedelta(seconds=30 * i), f)
    batches = [[at(i, True) for i in (0, 1, 3, 4, 5)], [at(2, False), *(at(i, True) for i in (6, 7, 8))], [at(9, None), at(60, True)]]
    schema = "rule string, service_name string, at timestamp, firing boolean"
    got = in_batches(spark, batches, schema, tmp_path, "late-hold", lambda s: alerts.changes_stream(s, 120, "4 minutes"))
    want = {("r", "s", T0 + timedelta(seconds=30 * 7), "firing"), ("r", "s", T0 + timedelta(seconds=30 * 9), "resolved")}
    assert {tuple(r) for r in got} == want and len(got) == 2
    flat = spark.createDataFrame([r for b in batches for r in b], schema)
    assert {tuple(r) for r in alerts.changes(flat, 120).select("rule", "service_name", "at", "status").collect()} == want


def looked_at_each_second(changed, last, wait, interval, repeat):
    """R7 by a clock: what a group of one alert delivers, second by second."""
    tick = sent = told = None
    firing, out, changed = False, [], dict(changed)
    for now in range(last + 1):
        if now in changed:
            firing = changed[now] == "firing"
            if firing and tick is None:
                tick = now + wait
        if tick == now:
            status = "firing" if firing else "resolved"
            if told is None and not firing:
                tick = None
                continue
            if told != status or now - sent >= repeat:
                out.append((now, status))
                sent, told = now, status
            tick = now + interval if firing else None
            if not firing:
                told = None
    return out


def test_notifications_against_a_clock(spark, tmp_path):
    rng = random.Random(4)
    changed, batches = {}, [[], [], []]
    for key in "abcdef":
        now = rng.randint(0, 40)
        changed[key] = []
        while now < 1500:
            changed[key].append((now, "firing" if len(changed[key]) % 2 == 0 else "resolved"))
            now += rng.choice([3, 8, 10, 17, 40, 55, 130, 400])
        for n, (second, status) in enumerate(changed[key]):
            batches[min(2, second // 600) if n % 4 else max(0, second // 600 - 1)].append((key, "s", T0 + timedelta(seconds=second), status))
    batches[2].append(("end", "s", T0 + timedelta(seconds=1630), "resolved"))
    got = in_batches(spark, batches, "rule string, service_name string, at timestamp, status string", tmp_path, "notify", lambda s: alerts.notifications(s, 10, 30, 200, "30 minutes").filter("rule <> 'end'"))
    assert got == []  # nothing has passed the watermark yet
    more = [[("end", "s", T0 + timedelta(seconds=1600 + 1800), "resolved")]]
    got = in_batches(spark, more, "rule string, service_name string, at timestamp, status string", tmp_path, "notify", lambda s: alerts.notifications(s, 10, 30, 200, "30 minutes").filter("rule <> 'end'"))
    want = sorted((k, *x) for k, c in changed.items() for x in looked_at_each_second(c, 1600, 10, 30, 200))
    assert sorted((r.rule, int((r.sent_at - T0).total_seconds()), r.status) for r in got) == want and len(want) > 20


def test_recovery_at_the_deadline(spark, tmp_path):
    """Late readings count in order; watches end once, as recovered, not_recovered or unknown."""
    row = lambda w, i, v, b=1.0: (w, T0 + timedelta(seconds=i), v, b, T0)
    batches = [
        [row("late", 15, 1.0), row("late", 60, 1.0), row("late", 75, 1.0), row("high", 15, 9.0), row("silent", 0, None), row("bare", 15, 1.0, None)],
        [row("late", 30, 9.0), row("late", 90, 9.0), row("late", 45, 1.0), row("high", 30, 9.0), row("after", 400, 1.0)],
        [row("clock", 1000, 9.0), row("high", 900, 1.0)],
    ]
    schema = "watch string, at timestamp, value double, baseline double, acted_at timestamp"
    got = in_batches(spark, batches, schema, tmp_path, "deadline", lambda s: watch.recovery_watch(s, 3, 300.0, "5 minutes"))
    assert sorted(tuple(r) for r in got) == [("bare", "unknown", None), ("high", "not_recovered", None), ("late", "recovered", 75.0), ("silent", "unknown", None)]


def test_earlier_crossing_that_comes_late(spark, tmp_path):
    row = lambda i, v, s="s": ("b", s, "m", T0 + timedelta(seconds=i), v)
    base = spark.createDataFrame([("b", s, "m", 1.0, 1.0) for s in ("s", "clock")], "bundle_id string, service_name string, metric_name string, median double, scale double")
    schema = "bundle_id string, service_name string, metric_name string, timestamp timestamp, value double"
    got = in_batches(spark, [[row(100, 9.0)], [row(80, 9.0), row(60, 2.0)], [row(500, 1.0, "clock"), row(120, 9.0)]], schema, tmp_path, "first", lambda s: watch.first_crossings(s, base, lateness="1 minute"))
    assert [(r.service_name, r.onset_at) for r in got] == [("s", T0 + timedelta(seconds=80))]


def test_late_rows_are_counted_over_all_batches(spark, tmp_path):
    """More batches than Spark keeps the progress of: from the third on each brings two rows that are too late.

    Spark drops by the watermark that it had a batch before.
    """
    path = str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for i in range(7):
            seconds = (0, 1000) if i == 0 else (5 + i, 20 + i, 1000 + i)
            spark.createDataFrame([(100 * i + s, T0 + timedelta(seconds=s)) for s in seconds], "id long, at timestamp").coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.02)  # files are read in the order of their times
        stream = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(path).withWatermark("at", "1 minute").dropDuplicatesWithinWatermark(["id"])
        with Totals(spark) as totals:
            query = stream.observe("rows", F.count("*").alias("kept")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert totals.late_rows(query) == totals.late_so_far(query) == 10
            assert totals.observed(query) == {"kept": 10}
            assert totals.batches[str(query.runId)] > len(query.recentProgress) <= 2
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


SPAN = "trace_id string, span_id string, parent_span_id string, service_name string, status_code string, start_time timestamp, duration_ms double"


def test_lone_calls_go_out_once_as_unknown(spark, tmp_path):
    """A call is unknown only when no partner can come any more; partners may come in later batches, on either side first."""
    span = lambda t, i, p, s, at: (t, i, p, s, "OK", T0 + timedelta(seconds=at), 1.0)
    batches = [
        [span("t", "a", None, "web", 0), span("t", "b", "a", "cart", 4), span("u", "a", None, "web", 2), span("v", "k", "j", "pay", 3)],
        [span("u", "x", "a", "stock", 9), span("v", "j", None, "late", 5), span("w", "q", "p", "lost", 6), span("x", "a", None, "far", 1), span("x", "z", "a", "far", 30)],
        [span("end", "e", "none", "end", 300)],
        [span("end", "f", "none", "end", 600)],
    ]
    path, name = tmp_path / "in", "lone"
    roots = F.col("span_id").isin("a", "j", "e", "f")
    observed = Counter()
    for rows in batches:
        spark.createDataFrame(rows, SPAN).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(SPAN).parquet(str(path))
        found = rollups.paired_or_unknown(stream.filter(roots), spark.readStream.schema(SPAN).parquet(str(path)))
        with Totals(spark) as totals:
            query = found.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
            observed.update(totals.observed(query))
    got = spark.read.schema(found.schema).parquet(str(tmp_path / name))
    rows = [(r.trace_id, r.client, r.server) for r in got.collect() if r.trace_id != "end"]
    assert sorted(rows) == [("t", "web", "cart"), ("u", "web", "stock"), ("v", "late", "pay"), ("w", "unknown", "lost"), ("x", "far", "unknown"), ("x", "unknown", "far")]
    whole = spark.createDataFrame([r for b in batches for r in b], SPAN)
    flat = rollups.paired_or_unknown(whole.filter(roots), whole).filter("trace_id <> 'end'")
    assert sorted((r.trace_id, r.client, r.server) for r in flat.collect()) == sorted(rows)
    ends = got.filter("trace_id = 'end'").count()  # those of the last watermark are still open
    assert observed["matched"] == 3 and observed["unknown_server"] + observed["unknown_client"] == 3 + ends
    counts = rollups.unknown_calls(got.filter("trace_id <> 'end'")).collect()
    assert {(r.service_name, r.missing, r.spans) for r in counts} == {("lost", "client", 1), ("far", "server", 1), ("far", "client", 1)}


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def in_steps(spark, batches, schema, tmp_path, name, transform):
    """The state's rows after each batch, and all rows given."""
    path, sizes = str(tmp_path / f"in-{name}"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = transform(spark.readStream.schema(schema).parquet(path))
        query = stream.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(state_rows(query))
    return sizes, spark.read.schema(stream.schema).parquet(f"{path}-out").collect()


def test_crossings_are_forgotten(spark, tmp_path):
    """A service's flag goes an hour after its last crossing; until then further crossings are not told again."""
    row = lambda b, s, i, v=9.0: (b, s, "m", T0 + timedelta(seconds=i), v)
    base = spark.createDataFrame([(b, f"s{i}", "m", 1.0, 1.0) for b in ("b", "clock") for i in range(40)], "bundle_id string, service_name string, metric_name string, median double, scale double")
    schema = "bundle_id string, service_name string, metric_name string, timestamp timestamp, value double"
    clock = lambda i: row("clock", "s0", i, 0.0)
    batches = [
        [row("b", f"s{i}", 10 + i) for i in range(40)] + [clock(200)],
        [row("b", "s7", 900), clock(1200)],
        [clock(3600 + 300)],  # an hour after all first crossings, but not after s7's last one
        [clock(3600 + 1200)],
    ]
    sizes, got = in_steps(spark, batches, schema, tmp_path, "forget", lambda s: watch.first_crossings(s, base, lateness="30 seconds", forget=3600))
    assert sorted((r.service_name, r.onset_at) for r in got) == sorted((f"s{i}", T0 + timedelta(seconds=10 + i)) for i in range(40))
    assert sizes[0] == sizes[1] >= 40 and 0 < sizes[2] <= sizes[1] // 40 and sizes[3] == 0


def test_watches_and_holds_are_forgotten(spark, tmp_path):
    reading = lambda w, i, v: (w, T0 + timedelta(seconds=i), v, 1.0, T0)
    batches = [[reading(f"w{i}", 15 * k, 1.0) for i in range(20) for k in range(4)] + [reading("clock", 100, 9.0)], [reading("clock", 1000, 9.0)], [reading("clock", 2000, 9.0)]]
    schema = "watch string, at timestamp, value double, baseline double, acted_at timestamp"
    sizes, got = in_steps(spark, batches, schema, tmp_path, "watches", watch.recovery_watch)
    assert sizes[0] >= 20 and sizes[-1] == 0 and {(r.watch, r.status) for r in got} == {*((f"w{i}", "recovered") for i in range(20)), ("clock", "not_recovered")}
    sample = lambda s, i, f: ("r", s, T0 + timedelta(seconds=i), f)
    batches = [
        [sample(f"s{i}", 30 * k, True) for i in range(20) for k in range(6)] + [sample("clock", 300, False)],
        [sample("s0", 400, True), sample("clock", 600, False)],
        [sample("clock", 900, False)],  # ten minutes after the last sample of all but s0
        [sample("s0", 901, False), sample("clock", 1000, False)],
    ]
    sizes, got = in_steps(spark, batches, "rule string, service_name string, at timestamp, firing boolean", tmp_path, "holds", lambda s: alerts.changes_stream(s, 120, "30 seconds", forget=600))
    assert sizes[0] >= 20 and 0 < sizes[2] < sizes[0] // 5
    assert sorted((r.service_name, r.status) for r in got if r.service_name != "clock") == sorted([*((f"s{i}", "firing") for i in range(20)), ("s0", "resolved")])


def test_onset_and_silence(spark, tmp_path):
    rows = [("b", "s", "m", T0 + timedelta(seconds=15 * i), float(i)) for i in range(10)] + [("far", "s", "m", T0 + timedelta(hours=2), 0.0)]
    _, stream = source(spark, rows, "bundle_id string, service_name string, metric_name string, timestamp timestamp, value double", tmp_path, 1)
    base = spark.createDataFrame([("b", "s", "m", 1.0, 1.0)], "bundle_id string, service_name string, metric_name string, median double, scale double")
    (r,) = run(spark, watch.first_crossings(stream, base), tmp_path, "onset").collect()
    assert r.onset_at == rows[4][3]
    silent = run(spark, watch.silences(stream), tmp_path, "silent").collect()
    assert [(r.bundle_id, r.silent_since) for r in silent] == [("b", rows[9][3])]


def test_pairs_repeats_and_delivery(spark, tmp_path):
    spans = [("t", "a", None, "web", "OK", T0, 5.0), ("t", "b", "a", "cart", "ERROR", T0 + timedelta(seconds=3), 2.0), ("t", "c", "a", "pay", "OK", T0 + timedelta(seconds=60), 2.0)]
    df = spark.createDataFrame(spans, "trace_id string, span_id string, parent_span_id string, service_name string, status_code string, start_time timestamp, duration_ms double")
    assert [(r.client, r.server) for r in rollups.paired(df, df).collect()] == [("web", "cart")]
    fired = [("r", "s", T0), ("r", "s", T0 + timedelta(minutes=5)), ("r", "u", T0)]
    _, stream = source(spark, fired, "rule string, service_name string, fired_at timestamp", tmp_path, 1)
    assert run(spark, alerts.without_repeats(stream), tmp_path, "once").count() == 2
    alerts.deliver(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_watches_are_kept_in_buckets(spark, tmp_path):
    """State and calls are a few for each bucket, whatever the number of watches; results are those of one watch after another."""
    rng = random.Random(11)
    names = [None, *(f"w{i}" for i in range(200))]
    reading = lambda w: (w, T0 + timedelta(milliseconds=rng.randrange(1000, 500_000)), rng.choice([None, 0.5, 1.0, 9.0, 9.0]), rng.choice([1.0, 1.0, 0.0, None]), T0)
    batches = [[reading(w) for w in names for _ in range(5)] for _ in range(2)]
    clock = lambda i: [("clock", T0 + timedelta(seconds=i), 9.0, 1.0, T0 + timedelta(seconds=i))]
    schema = "watch string, at timestamp, value double, baseline double, acted_at timestamp"
    sizes, got = in_steps(spark, [*batches, clock(700), clock(1200)], schema, tmp_path, "buckets", lambda s: watch.recovery_watch(s, 2, 300.0, "10 minutes", 3))
    want = {}
    for w in names:
        count, want[w] = 0, ("unknown", None)
        for _, at, value, baseline, _ in sorted((r for rows in batches for r in rows if r[0] == w), key=lambda r: r[1]):
            if at <= T0 + timedelta(seconds=300) and None not in (value, baseline) and want[w][0] != "recovered":
                count = count + 1 if value <= (1.25 * baseline if baseline > 0 else watch.RECOVERY_FLOOR) else 0
                want[w] = ("recovered", (at - T0) / timedelta(seconds=1)) if count == 2 else ("not_recovered", None)
    assert sorted(((r.watch or "", r.status, r.after_seconds) for r in got if r.watch != "clock"), key=str) == sorted(((w or "", *x) for w, x in want.items()), key=str)
    assert {s for s, _ in want.values()} >= {"recovered", "not_recovered"} and max(sizes) <= 20
