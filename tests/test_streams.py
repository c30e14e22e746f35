"""Stateful operators on real streams, and rules' state machines."""

from __future__ import annotations

import json
import time
import os

import pytest
from pyspark.sql import functions as F

from quadrille.operators import metrics_api, storage
from quadrille.plans import promql
from quadrille.streaming import rules, traces

SPAN = "trace_id string, span_id string, parent_span_id string, name string, kind int, status int, service string, start_ns long, duration_ns long, attrs map<string,string>"


def span(trace, sid, parent, kind, service, status=0, attrs=None, start=0):
    return {"trace_id": trace, "span_id": sid, "parent_span_id": parent, "name": "op", "kind": kind, "status": status, "service": service, "start_ns": start, "duration_ns": 5_000_000, "attrs": attrs or {}}


ROWS = [
    span("t1", "a", None, traces.CLIENT, "web"), span("t1", "b", "a", traces.SERVER, "api", 2), span("t2", "a", None, traces.CLIENT, "web", attrs={"peer.service": "outside"}),
    span("t3", "x", "gone", traces.SERVER, "api"), span("t4", "p", None, traces.PRODUCER, "web", attrs={"messaging.system": "queue"}), span("t4", "c", "p", traces.CONSUMER, "worker", start=10**10),
]


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], SPAN)


def test_edges(spans):
    got = {(r.client, r.server, r.connection, r.failed, r.state) for r in traces.edges(spans).collect()}
    assert got == {("web", "api", "", True, "complete"), ("web", "outside", "virtual_node", False, "virtual"), (None, "api", "", False, "unpaired"), ("web", "worker", "messaging_system", False, "complete")}
    assert {r.state for r in traces.edges(spans, ttl_ns=10**9).filter("server = 'worker'").collect()} == {"unpaired"}


def test_red(spans):
    rows = {(r.service, r.span_kind, r.status_code): (r.calls, r.le_0, r.le_2) for r in traces.red(spans).collect()}
    assert rows["web", "client", "unset"] == (2.0, 0.0, 2.0) and rows["api", "server", "error"][0] == 1.0
    names = {r.name for r in traces.red_samples(traces.red(spans), 5).select("name").distinct().collect()}
    assert names == {"traces_spanmetrics_" + n for n in ("calls_total", "size_total", "latency_bucket", "latency_sum", "latency_count")}
    kept, lost = traces.capped(traces.red(spans), spans, 2)
    assert kept.select("service").distinct().count() == 2 and lost.first().discarded == 1


def run_stream(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    end = time.time() + 120
    while query.isActive and time.time() < end:  # a state with time-outs keeps the query going with empty batches
        seen = [p["numInputRows"] for p in query.recentProgress]
        if any(seen) and seen[-1] == 0:
            break
        time.sleep(0.3)
    query.stop()
    assert query.exception() is None
    return stream.sparkSession.table(name).collect()


def test_stream_edges(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in ROWS[:1] + ROWS[4:5]))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in ROWS[1:2] + ROWS[5:]))
    stream = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = {(r.client, r.server, r.failed, r.state) for r in run_stream(traces.stream_edges(stream, 600_000), "edges")}
    assert got == {("web", "api", True, "complete"), ("web", "worker", False, "complete")}


DELTAS = [("s", 1, 0, 1.0), ("s", 2, 5, 2.0), ("s", 3, 5, 3.0), ("s", 4, 9, 4.0), ("s", 5, 0, 5.0), ("r", 1, 5, 7.0)]


def test_cumulative(spark, tmp_path):
    want = {("s", 1, 1.0), ("s", 2, 3.0), ("s", 3, 6.0), ("s", 4, 4.0), ("s", 5, 9.0), ("r", 1, 7.0)}
    df = spark.createDataFrame(DELTAS, "series string, ts long, start_ts long, v double")
    assert {(r.series, r.ts, r.v) for r in traces.cumulative(df).collect()} == want
    for k, part in enumerate((DELTAS[:2], DELTAS[2:])):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("series", "ts", "start_ts", "v"), r, strict=True))) for r in part))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))  # the source takes files by age
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    assert {(r.series, r.ts, r.v) for r in run_stream(traces.stream_cumulative(stream), "totals")} == want


def test_stream_red(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in ROWS))
    stream = spark.readStream.schema(SPAN).json(str(tmp_path)).withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000)))
    rows = run_stream(traces.red(stream, watermark="1 minute", every="1 minute"), "red", "complete")
    assert {(r.service, r.calls) for r in rows if r.span_kind == "client"} == {("web", 2.0)}


def test_alert_states(spark):
    ls = [("a", "1")]
    on = [10, 20, 30, 60, 100, 200]
    df = spark.createDataFrame([(ls, t, 1.0) for t in on], "ls array<struct<k:string,v:string>>, ts long, v double")
    got = {r.ts: (r.state, r.since) for r in rules.alert_states(df, 10, hold=20).collect()}
    assert got == {10: ("pending", 10), 20: ("pending", 10), 30: ("firing", 10), 60: ("pending", 60), 100: ("pending", 100), 200: ("pending", 200)}
    got = {r.ts: (r.state, r.since) for r in rules.alert_states(df, 10, hold=20, keep_firing=25, end=300).collect()}
    assert got == {10: ("pending", 10), 20: ("pending", 10), **{t: ("firing", 10) for t in (30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130)}, 200: ("pending", 200)}


def test_rules(spark):
    samples = spark.createDataFrame([("up", {"job": "x"}, t * 1000, float(t % 40 < 20)) for t in range(0, 120, 10)], "name string, labels map<string,string>, ts long, v double")
    store = promql.Store(samples)
    rows = rules.alerting_rule(store, "Down", "up == 0", 0, 110_000, 10_000, hold=10_000, labels={"severity": "page", "job": ""}, lookback=10_000).collect()
    assert {(r.labels["alertstate"], r.ts) for r in rows if r.name == "ALERTS"} == {(s, t * 1000) for s, t in (("pending", 20), ("firing", 30), ("pending", 60), ("firing", 70), ("pending", 100), ("firing", 110))}
    assert all("job" not in r.labels and r.labels["severity"] == "page" for r in rows)
    made = rules.recording_rule(store, "jobs:up", "count(up)", 0, 0, 1, {"a": "b"}, 10_000).first()
    assert (made.name, made.labels, made.v) == ("jobs:up", {"a": "b"}, 1.0)


def test_tail(spark, tmp_path):
    rows = [{"labels": {"app": a}, "ts_ns": t, "line": line, "metadata": {}} for a, t, line in (("x", 1, "keep 1"), ("x", 2, "drop"), ("y", 3, "keep 2"))]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    logs = spark.readStream.schema("labels map<string,string>, ts_ns long, line string, metadata map<string,string>").json(str(tmp_path))
    assert [(r.ts_ns, r.line) for r in run_stream(rules.tail(logs, '{app="x"} |= "keep" | line_format "{{.app}}"'), "tailed")] == [(1, "x")]


def test_blocks(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"id": k % 3, "ts": k * storage.DAY_MS // 2, "v": k}) for k in range(10)))
    stream = spark.readStream.schema("id long, ts long, v long").json(str(src))
    rules.build_blocks(stream, out, str(tmp_path / "cp"), "ts", ["id", "ts"], storage.DAY_MS).awaitTermination(120)
    back = spark.read.parquet(out + "/batch=0")
    assert back.count() == 10 and {r.day for r in back.select("day").distinct().collect()} == set(range(5))
    storage.compact(spark, out + "/batch=0", str(tmp_path / "compact"), "ts", ["id", "ts"], ["id"], "ts")
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "compact")).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_replicas(spark):
    rows = [("m", {"cluster": "c", "replica": r}, t, 1.0) for r, ts in (("a", (0, 10_000, 70_000)), ("b", (1000, 40_000, 71_000))) for t in ts] + [("m", {"job": "x"}, 5, 2.0)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, ts long, v double")
    got = sorted((r.ts, tuple(r.labels)) for r in storage.elect_replicas(df, "cluster", "replica").collect())
    assert got == [(0, ("cluster",)), (5, ("job",)), (10_000, ("cluster",)), (70_000, ("cluster",))]  # b speaks when a has been silent for 30 s, no longer


def test_search_names(spark):
    names = spark.createDataFrame([("http_requests_total",), ("http_request_seconds",), ("cpu_time",)], "name string")
    assert [r.name for r in metrics_api.search_names(names, "http_requests_totl").collect()][0] == "http_requests_total"
    assert metrics_api.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
