import hashlib
import json

import pytest

from quakelens.operators import governance
from quakelens.sources import normalise, readers, schemas, writers


def test_range_results(spark):
    rows = [({"service_name": "a", "z": "1", "b": "2"}, [["1704067200.5", "3.5"], ["1704067215", "NaN"], ["x", "1"], ["1704067230", "oops"]]), ({"client": "c"}, [["1704067200", "1"]]), ({"other": "c"}, [["1704067200", "1"]])]
    got = normalise.metric_rows(spark.createDataFrame(rows, normalise.RANGE_RESULT), "calls").orderBy("service_name").collect()
    assert [(r.service_name, r.value) for r in got] == [("a", 3.5), ("c", 1.0)] and got[0].labels_json == '{"b":"2","service_name":"a","z":"1"}'


def test_span_exports(spark, tmp_path):
    span = lambda i, refs, tags, p="p1": {"traceID": "t", "spanID": i, "operationName": "op", "references": refs, "startTime": 1_704_067_200_000_001, "duration": 1500, "tags": tags, "processID": p}
    data = {"data": [{"processes": {"p1": {"serviceName": "cart"}}, "spans": [span("a", [], [{"key": "span.kind", "value": "server"}]), span("b", [{"refType": "FOLLOWS_FROM", "spanID": "x"}, {"refType": "CHILD_OF", "spanID": "a"}], [{"key": "error", "value": "true"}]), span("b", [], []), span("c", [], [{"key": "otel.status_code", "value": "ok"}]), span("d", [], [], "p9")]}]}
    (tmp_path / "x.json").write_text(json.dumps(data))
    got = {r.span_id: r for r in normalise.span_rows(spark.read.schema(normalise.SPAN_EXPORT).json(str(tmp_path / "x.json"))).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].span_kind == "SERVER" and got["a"].status_code == "STATUS_CODE_UNSET" and got["c"].status_code == "STATUS_CODE_OK" and got["a"].duration_ms == 1.5


def test_log_exports(spark):
    rows = [("2024-01-01T00:00:00.123456789Z", "a", "warn", "x", "", {"k": "v"}), ("2024-01-01T00:00:00Z", "", "info", "x", None, None), ("2024-01-01T00:00:00Z", "a", "", "", None, None), ("2024-01-01T00:00:00Z", "otel-collector", "info", "x", None, None), ("2024-01-01T00:00:01Z", "b", None, "y", "t", None)]
    got = normalise.log_rows(spark.createDataFrame(rows, normalise.LOG_EXPORT)).orderBy("service_name").collect()
    assert [(r.service_name, r.severity, r.trace_id) for r in got] == [("a", "WARN", None), ("b", "UNSPECIFIED", "t")] and got[0].timestamp.microsecond == 123456


def test_bundles(spark, tmp_path):
    b = tmp_path / "inc_1"
    b.mkdir()
    edge = {"client": "a", "server": "b", "requests_per_second": 2.0, "failures_per_second": 1.0, "error_ratio": 9.0}
    (b / "topology.json").write_text(json.dumps({"services": ["a", "b"], "edges": [edge]}))
    (b / "changes.json").write_text(json.dumps([{"at": "2024-01-01T00:00:00Z", "kind": "deploy", "service": "a", "detail": "x"}]))
    (b / "manifest.json").write_text(json.dumps({"bundle_id": "inc_1", "window": {"start": "2024-01-01T00:00:00Z", "end": "2024-01-01T01:00:00Z"}, "files": [{"name": "metrics.parquet", "rows": 7}]}))
    assert readers.read_topology(spark, str(tmp_path)).collect()[0].error_ratio == 0.5
    assert readers.read_changes(spark, str(tmp_path)).collect()[0].bundle_id == "inc_1"
    assert readers.library_index(spark, str(tmp_path)).collect()[0].rows == {"metrics.parquet": 7}
    (b / "topology.json").write_text(json.dumps({"edges": [edge | {"requests_per_second": -1}]}))
    with pytest.raises(Exception, match="malformed"):
        readers.read_topology(spark, str(tmp_path)).collect()


def test_lines_alerts_runbooks(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert readers.read_lines(spark, str(p), "a int", strict=False).count() == 2 and readers.bad_lines(spark, str(p), "a int") == 1
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_lines(spark, str(p), "a int").collect()
    p.write_text(json.dumps({"received_at": "2024-01-01T00:00:00Z", "payload": {"alerts": [{"status": "firing", "labels": {"alertname": "X"}}, {"status": "resolved", "labels": {}}]}}) + "\n" + json.dumps({"payload": {}}) + "\n")
    got = readers.read_alerts(spark, str(p)).collect()
    assert len(got) == 3 and got[0].summary == "2 alert(s): X[firing], unnamed[resolved]"
    (tmp_path / "r.md").write_text("---\nid: rb-1\ntitle: Cart is slow\ncovers: [cart, web]\nsymptoms: [latency]\n---\nIntro\n## Checks\nLook.\n")
    (book,) = readers.read_runbooks(spark, str(tmp_path / "r.md")).collect()
    assert book.covers == ["cart", "web"] and book.runbook_id == "rb-1" and book.body.startswith("Intro")


def test_contract(spark, tmp_path):
    good = spark.sql("select timestamp'2024-01-01' as timestamp, 'm' as metric_name, 's' as service_name, '{}' as labels_json, 1.0D as value")
    assert writers.write_table(good, schemas.METRICS, str(tmp_path / "m")) == 1
    with pytest.raises(ValueError, match="unexpected column x"):
        schemas.enforced(good.selectExpr("*", "1 as x"), schemas.METRICS)
    with pytest.raises(Exception, match="required column value is null"):
        writers.write_table(good.selectExpr("timestamp", "metric_name", "service_name", "labels_json", "cast(null as double) as value"), schemas.METRICS, str(tmp_path / "n"))


def test_files_against_manifests(spark, tmp_path):
    """V10 over real files: what is missing, changed, unlisted, forbidden or omitted, and a folder without a manifest."""
    files = {"good": {"a.bin": b"1" * 5000, "b.json": b"{}"}, "bad": {"a.bin": b"2", "more.txt": b"", "labels.json": b"[]"}, "bare": {"x": b"x"}}
    for bundle, own in files.items():
        (tmp_path / bundle).mkdir()
        for name, content in own.items():
            (tmp_path / bundle / name).write_bytes(content)
    listed = lambda *names: [{"name": n, "sha256": hashlib.sha256(c).hexdigest(), "bytes": len(c)} for n, c in names]
    (tmp_path / "good" / "manifest.json").write_text(json.dumps({"bundle_id": "good", "files": listed(*files["good"].items())}))
    (tmp_path / "bad" / "manifest.json").write_text(json.dumps({"bundle_id": "bad", "files": listed(("a.bin", b"changed"), ("gone", b""), ("labels.json", b"[]"))}))
    found = readers.bundle_files(spark, str(tmp_path))
    assert {(r.bundle_id, r.name, r.bytes) for r in found.collect() if r.name != "manifest.json"} == {(b, n, len(c)) for b, own in files.items() for n, c in own.items()}
    got = governance.bundle_findings(found, readers.manifest_files(spark, str(tmp_path)), ["a.bin", "b.json"], ["labels.json"])
    want = {("bad", "a.bin", "changed"), ("bad", "gone", "missing"), ("bad", "more.txt", "unlisted"), ("bad", "labels.json", "forbidden"), ("bad", "b.json", "omitted"), ("bare", "x", "unlisted"), ("bare", "manifest.json", "bare")}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize(("top", "edge"), [({}, {}), ({"note": 1}, {}), ({}, {"protocol": "grpc"})])
def test_unknown_topology_fields_stop(spark, tmp_path, top, edge):
    (tmp_path / "b").mkdir()
    edges = [{"client": "a", "server": "b", "requests_per_second": 2.0, "failures_per_second": 1.0, "error_ratio": 0.9}, {"client": "b", "server": "c", "requests_per_second": 1, "failures_per_second": 0, **edge}]
    (tmp_path / "b" / "topology.json").write_text(json.dumps({"window_start": "2024-01-01T00:00:00Z", "services": ["a"], "edges": edges, **top}, indent=1))
    found = readers.read_topology(spark, str(tmp_path))
    if top or edge:
        with pytest.raises(Exception, match="unknown fields.*(note|protocol)"):
            found.collect()
    else:
        assert [(r.bundle_id, r.client, r.error_ratio) for r in found.orderBy("client").collect()] == [("b", "a", 0.5), ("b", "b", 0.0)]
