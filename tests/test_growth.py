"""Steps whose cost must not grow faster than the input: what they write, shuffle and hold."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.operators import retrieval, safety, traces
from quakelens.plans import graph_queries, source_queries, stream_queries
from quakelens.sources.staging import shared_dir
from quakelens.streaming import rollups

SMALL = "/root/testdata/sf0.001"
SPAN = "trace_id long, span_id string, parent_span_id string, service_name string, span_name string, duration_ms double"


def test_paths_are_followed_in_rounds_of_hops(spark, monkeypatch):
    """A short path takes one written table; long ones, circles of repeated ids and null traces come out whole."""
    written = []
    staged = traces.staged
    monkeypatch.setattr(traces, "staged", lambda df, name: written.append(name) or staged(df, name))
    row = lambda t, i, p, ms=1.0: (t, i, p, "s", "n", ms)
    chain = [row(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(4)]
    assert [r.span_id for r in traces.critical_paths(spark.createDataFrame(chain, SPAN)).orderBy("hop").collect()] == ["c0", "c1", "c2", "c3"]
    assert written == ["path"]
    long = [row(2, f"c{i:02}", f"c{i - 1:02}" if i else "gone") for i in range(60)]
    circle = [row(3, "a", None, 9.0), row(3, "b", "a"), row(3, "a", "b")]
    none = [row(None, "x", None, 2.0), row(None, "y", "x", 3.0)]
    found = {}
    for r in traces.critical_paths(spark.createDataFrame(chain + long + circle + none, SPAN)).orderBy("hop").collect():
        found.setdefault(r.trace_id, []).append((r.hop, r.span_id))
    assert found[2] == [(i, f"c{i:02}") for i in range(traces.MAX_HOPS + 1)] and found[1] == [(i, f"c{i}") for i in range(4)]
    assert found[3] == [(i, "ab"[i % 2]) for i in range(traces.MAX_HOPS + 1)] and found[None] == [(0, "y")]


def test_exports_are_compressed(spark):
    source_queries.QUERIES["s12_span_exports"](spark, SMALL).count()
    folders = [p for p in Path(shared_dir(spark)).glob("staged-*/traces-*") if p.is_dir()]
    assert folders and all(f.suffix == ".gz" for p in folders for f in p.glob("part-*"))


def test_masks_look_to_the_outside_only(spark):
    """L1: masks give what full word boundaries give."""
    rng = random.Random(3)
    bits = ["deadbeef", "0123abcd", "10.0.0.1", "2024-01-02T03:04:05.5Z", "-", "_", " ", "x", "é", '"q"', "'", "7", "1234567890abcdef", "4f5e6a7b-1111-2222-3333-abcdefabcdef", "FACEFEED", "+01:00", "."]
    rows = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))),) for _ in range(3000)], "body string")
    want = F.col("body")
    for pattern, mark in C.MASK:
        want = F.regexp_replace(want, C.ascii_bounded(pattern), mark)
    assert rows.filter(~want.eqNullSafe(C.mask_log(F.col("body")))).count() == 0


def test_points_of_sections_are_not_shuffled(spark, tmp_path):
    """Words and points are grouped where their section lies."""
    parts = spark.createDataFrame([(i, 0, "t", "h", ["svc"], f"word{i} disk.") for i in range(50)], "runbook_id long, number int, title string, heading string, covers array<string>, text string")
    asked = spark.createDataFrame([(1, "word3 disk", "svc"), (2, None, None)], "query_id long, text string, service string")
    asked.write.parquet(str(tmp_path / "asked"))
    found = retrieval.score_sections(parts, spark.read.parquet(str(tmp_path / "asked")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and plan.count("hashpartitioning(") <= 1
    assert {(r.query_id, r.runbook_id): r.score for r in found.collect()}[(1, 3)] == round(2 / 2.2 + 4.0, 6)


def test_spans_come_in_slices_of_time(spark):
    """Slices of time, each a run from one checkpoint, give the rows of a single run."""
    one, many = (stream_queries._unmatched(spark, SMALL, n) for n in (10_000_000, 3000))
    assert one.count() > 7000 and one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


TIMED = "trace_id long, span_id string, parent_span_id string, service_name string, status_code string, start_time timestamp, duration_ms double"


def test_batches_pair_as_the_stateful_join_does(spark, tmp_path):
    """Pairs and lone spans of a stateless run by batches are those of the join with state, late rows and repeats included."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    ends = (rollups.paired_or_unknown, "state"), (rollups.paired_in_batches, "batches")
    for n in range(5):
        rows = []
        for _ in range(300):
            at = start + timedelta(seconds=60 * n + rng.randint(-50, 60), milliseconds=rng.choice([0, 0, 7]), microseconds=rng.choice([0, 1]))
            rows.append((rng.choice([None, *range(12)]), rng.choice("abcdef"), rng.choice([*"abcdef", None]), rng.choice(["s", "t", None]), "OK", rng.choice([at, at, at, None]) if n else at, 1.0))
        rows += rows[:20]
        spark.createDataFrame(rows, TIMED).write.mode("append").parquet(str(tmp_path / "in"))
        for pairing, name in ends:
            callers, called = (spark.readStream.schema(TIMED).parquet(str(tmp_path / "in")).filter(kind) for kind in ("span_id in ('a', 'b', 'c', 'd')", "parent_span_id is null or span_id > 'a'"))
            if name == "state":
                stream = pairing(callers, called)
                writer = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append")
            else:
                writer = pairing(callers, called, str(tmp_path / name))
            query = writer.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert bool(query.lastProgress.stateOperators) == (name == "state")
    want = spark.read.schema(stream.schema).parquet(str(tmp_path / "state"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "batches" / "pairs" / "batch=*"))
    # A trace's null equals no other, as in SQL; a join with state takes nulls for equal.
    assert got.filter("trace_id is null").count() > 10 and got.filter("trace_id is null and client <> 'unknown' and server <> 'unknown'").count() == 0
    want, got = (x.filter("trace_id is not null") for x in (want, got))
    kinds = {(r.client == "unknown", r.server == "unknown") for r in want.collect()}
    assert want.count() > 1000 and {(False, False), (False, True), (True, False)} <= kinds
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    # What waits for the next batch: two times to live and the lateness, not what has been seen.
    waiting = spark.read.parquet(str(tmp_path / "batches" / "waiting" / "0"))
    first, last = waiting.agg(F.min("start_time"), F.max("start_time")).first()
    assert last - first <= timedelta(seconds=2 * 10 + 30 + 1) and waiting.count() < 700


def test_slices_are_written_and_read_once(spark, monkeypatch):
    """A run reads its slice and no other; no run keeps rows in a state."""
    runs, pairing = [], rollups.paired_in_batches
    before = set(Path(shared_dir(spark)).glob("staged-*/spans-*"))
    seen = lambda: [f for p in Path(shared_dir(spark)).glob("staged-*/spans-*") if p not in before for f in p.glob("*/part-*")]
    monkeypatch.setattr(rollups, "paired_in_batches", lambda *given: runs.append(seen()) or pairing(*given))
    found = stream_queries._unmatched(spark, SMALL, 2000)
    folders = [{f.parent.name for f in files} for files in runs]
    assert folders == [{str(k) for k in range(i + 1)} for i in range(len(runs))] and len(runs) == 4
    slices = [spark.read.parquet(*{str(f.parent) for f in runs[-1] if f.parent.name == str(i)}) for i in range(4)]
    bounds = [tuple(x.agg(F.min("start_time"), F.max("start_time")).first()) for x in slices]
    assert sum(x.count() for x in slices) == 7500 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert found.exceptAll(stream_queries._unmatched(spark, SMALL)).count() == 0


def test_pairs_of_no_spans(spark, tmp_path):
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert stream_queries._unmatched(spark, str(tmp_path)).count() == 0


def test_texts_become_objects_by_pieces(monkeypatch):
    """Pieces of a part give the hits of the whole, each at its own text."""
    monkeypatch.setattr(safety, "TEXTS_AT_ONCE", 7)
    texts = pa.table({"place": list(range(100)), "text": [f"a {i}." for i in range(100)]})
    found = safety._found_in(("item", "place"))(texts, pa.table({"item": ["x", "y"], "marker": [" 31.", "5."]}))
    assert sorted(zip(*found.to_pydict().values(), strict=True)) == [("x", 31), *(("y", i) for i in range(5, 100, 10))]


def test_timed_paths_are_those_of_the_join(spark):
    """Self times that paths meet on their way are those of a join, also where spans repeat, lack values or go round."""
    rng = random.Random(5)
    value = lambda: rng.choice([None, 1.0, 2.0, 5.0, float(rng.randint(1, 30))])
    spans = [(rng.randint(0, 150) or None, rng.choice([*"abcdefgh", None]), rng.choice([*"abcdefgh", None, "gone"]), rng.choice("st"), "n", value()) for _ in range(900)]
    spans += [(1000 + k, f"c{i:02}", f"c{i - 1:02}" if i else None, "s", "n", float(i)) for k in range(3) for i in range((4, 13, 60)[k]) for _ in range(1 + (i % 6 == 5))]
    table = spark.createDataFrame(spans, SPAN)
    joined = traces.path_rows(table, traces.critical_paths(table))
    timed = traces.path_rows(table, traces.critical_paths(table, timed=True))
    assert timed.columns == joined.columns and joined.count() > 300
    assert joined.exceptAll(timed).count() == 0 and timed.exceptAll(joined).count() == 0


def test_spans_are_dealt_once(spark, monkeypatch):
    """Orders and lines are shuffled once each, and nothing more within traces; X4's rows need no shuffle after."""
    shuffles, staged = [], traces.staged
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    monkeypatch.setattr(traces, "staged", lambda df, name: shuffles.append(exchanges(df)) or staged(df, name))
    left = {q: exchanges(graph_queries.QUERIES[q](spark, SMALL)) for q in ("x02_critical_path", "x04_path_rows", "x06_path_text")}
    assert shuffles == [2, 2, 2] and left["x02_critical_path"] == left["x04_path_rows"] == 0 and left["x06_path_text"] <= 1


def test_gathered_paths_give_the_same_texts(spark):
    """Texts of gathered hops are those of paths grouped row by row, over one round and several."""
    rng = random.Random(6)
    value = lambda: rng.choice([None, 2.0, float(rng.randint(1, 30))])
    spans = [(rng.randint(0, 120) or None, rng.choice([*"abcdef", None]), rng.choice([*"abcdef", None, "gone"]), rng.choice(["s", "t", None]), "n", value()) for _ in range(700)]
    spans += [(1000 + k, f"c{i:02}", f"c{i - 1:02}" if i else None, "s", f"n{i}", float(i % 7)) for k in range(4) for i in range((4, 6, 13, 60)[k])]
    table = spark.createDataFrame(spans, SPAN)
    texts = traces.path_text(traces.critical_paths(table, gathered=True))
    plain = {r.trace_id: sorted((h.hop, h.duration_ms, h.service_name, h.span_name) for h in r.path) for r in traces.critical_paths(table).filter("trace_id >= 1000").groupBy("trace_id").agg(F.collect_list(F.struct("hop", "duration_ms", "service_name", "span_name")).alias("path")).collect()}
    rowwise = traces.path_text(traces.critical_paths(table))
    assert rowwise.exceptAll(texts).count() == 0 and texts.exceptAll(rowwise).count() == 0 and texts.count() > 100
    want = {t: " -> ".join(f"{x[2]}:{x[3]}" for x in p) + f" ({max(x[1] for x in p):.0f}ms slowest: s)" for t, p in plain.items()}
    assert len(plain[1003]) == traces.MAX_HOPS + 1 and {r.trace_id: r.path for r in texts.collect() if (r.trace_id or 0) >= 1000} == want
