"""Decoders: hand-made messages, round trips and small documents."""

from __future__ import annotations

import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.sources import ingest, wire


def snappy(data: bytes) -> bytes:
    """Literals, and one overlapping copy if the data ends in a run."""
    run = len(data) - len(data.rstrip(data[-1:])) if data else 0
    head, tail = (data[: len(data) - run + 1], run - 1) if run > 5 else (data, 0)
    out = wire.put_varint(len(data))
    for k in range(0, len(head), 60):
        part = head[k : k + 60]
        out += bytes([(len(part) - 1) << 2]) + part
    while tail:
        n = min(tail, 64)
        out += bytes([(n - 1) << 2 | 2, 1, 0])
        tail -= n
    return out


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 200))
def test_snappy(data, run):
    data += b"z" * run
    assert wire.unsnappy(snappy(data)) == data


@settings(max_examples=50, deadline=None)
@given(st.integers(0, (1 << 64) - 1))
def test_varint(n):
    assert wire.varint(wire.put_varint(n), 0)[0] == n


def test_bad_bytes():
    for data in (b"\x0a\xff", b"\xff" * 11, b"\x0f"):
        with pytest.raises(wire.WireError):
            wire.message(data)
    with pytest.raises(wire.WireError):
        wire.unsnappy(b"\x05\x01\x09")


class Bits:
    def __init__(self):
        self.text = ""

    def add(self, value: int, n: int) -> None:
        self.text += format(value & (1 << n) - 1, f"0{n}b")

    def bytes(self) -> bytes:
        text = self.text + "0" * (-len(self.text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def xor_chunk(rows: list[tuple[int, float]]) -> bytes:
    raw = lambda v: struct.unpack(">Q", struct.pack(">d", v))[0]
    t, v = rows[0]
    out = struct.pack(">H", len(rows)) + wire.put_varint((t << 1) ^ (t >> 63)) + struct.pack(">d", v)
    bits, delta, first = Bits(), 0, True
    last = raw(v)
    for u, w in rows[1:]:
        if first:
            delta, first = u - t, False
            out += wire.put_varint(delta)
        else:
            d = u - t - delta
            delta = u - t
            for ones, n in ((0, 0), (1, 14), (2, 17), (3, 20), (4, 64)):
                if d == 0 and ones == 0 or ones and -(1 << (n - 1)) + 1 <= d <= 1 << (n - 1):
                    break
            bits.add((1 << ones) - 1 << (ones < 4), ones + (ones < 4))
            bits.add(d, n) if n else None
        x = raw(w) ^ last
        if x == 0:
            bits.add(0, 1)
        else:
            lead = min(31, 64 - x.bit_length())
            trail = (x & -x).bit_length() - 1
            size = 64 - lead - trail
            bits.add(3, 2), bits.add(lead, 5), bits.add(size, 6), bits.add(x >> trail, size)
        t, last = u, raw(w)
    return out + bits.bytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100_000), st.floats(allow_nan=False)), min_size=1, max_size=20), st.integers(0, 1 << 41))
def test_xor_round_trip(steps, start):
    rows, t = [], start
    for d, v in steps:
        rows.append((t, v))
        t += d
    assert wire.xor_chunk(xor_chunk(rows)) == rows


def test_remote_write(spark):
    label = lambda k, v: wire.put(1, wire.put(1, k) + wire.put(2, v))
    sample = lambda v, t: wire.put(2, wire.put(1, v) + wire.put(2, t))
    one = snappy(wire.put(1, label("__name__", "up") + label("job", "x") + sample(1.0, 1000) + sample(0.5, 2000)))
    two = snappy(b"".join(wire.put(4, s) for s in ("", "__name__", "up", "job", "x")) + wire.put(5, wire.put(1, bytes([1, 2, 3, 4])) + sample(2.0, 3000)))
    got = lambda body, n: [(r.name, r.labels, r.ts, r.v) for r in ingest.remote_write(spark.createDataFrame([(body,)], "body binary"), n).collect()]
    assert got(one, 1) == [("up", {"job": "x"}, 1000, 1.0), ("up", {"job": "x"}, 2000, 0.5)]
    assert got(two, 2) == [("up", {"job": "x"}, 3000, 2.0)]


def test_xor_chunks(spark):
    df = spark.createDataFrame([({"a": "b"}, xor_chunk([(1, 1.0), (5, 2.0), (9, 2.0)]))], "labels map<string,string>, chunk binary")
    assert [(r.labels, r.ts, r.v) for r in ingest.xor_chunks(df).collect()] == [({"a": "b"}, 1, 1.0), ({"a": "b"}, 5, 2.0), ({"a": "b"}, 9, 2.0)]


def test_influx(spark):
    lines = ['cpu,host=a\\ b,dc=x usage=1.5,count=3i,text="no, thing",up=t 1000000000', "mem value=7 2000000000", "# comment", "broken", 'load,host=c value=-2e3']
    rows = {(r.name, tuple(sorted(r.labels.items())), r.ts, r.v) for r in ingest.influx(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    host = (("dc", "x"), ("host", "a b"))
    assert rows == {("cpu_usage", host, 1000, 1.5), ("cpu_count", host, 1000, 3.0), ("cpu_up", host, 1000, 1.0), ("mem", (), 2000, 7.0), ("load", (("host", "c"),), None, -2000.0)}


def body(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "body string")


def test_loki(spark):
    push = {"streams": [{"stream": {"app": "x"}, "values": [["1", "one"], ["2", "two", {"pod": "p"}]]}]}
    assert [(r.labels, r.ts_ns, r.line, r.metadata) for r in ingest.loki_push(body(spark, push).select("body")).collect()][1][:3] == ({"app": "x"}, 2, "two")


def attr(k, **v):
    return {"key": k, "value": v}


def test_otlp(spark):
    resource = {"attributes": [attr("service.name", stringValue="shop"), attr("service.instance.id", stringValue="i1")]}
    log = {"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [{"timeUnixNano": "5", "severityText": "INFO", "body": {"stringValue": "hi"}, "attributes": [attr("a.b", intValue="3")]}]}]}]}
    r = ingest.otlp_logs(body(spark, log)).first()
    assert (r.labels["service_name"], r.ts_ns, r.line, r.metadata) == ("shop", 5, "hi", {"a_b": "3", "severity_text": "INFO"})
    span = {"traceId": "t", "spanId": "s", "parentSpanId": "", "name": "op", "kind": 2, "startTimeUnixNano": "10", "endTimeUnixNano": "35", "status": {"code": 2}, "attributes": [attr("n", intValue="4"), attr("f", boolValue=True), attr("x", stringValue="y")], "events": [{"name": "e", "timeUnixNano": "12"}]}
    s = ingest.otlp_traces(body(spark, {"resourceSpans": [{"resource": resource, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span]}]}]})).first()
    assert (s.parent_span_id, s.duration_ns, s.status, s.service, s.attrs, s.nums, s.bools, s.instrumentation_name, s.events[0].time_since_start_ns) == (None, 25, 2, "shop", {"x": "y"}, {"n": 4.0}, {"f": True}, "lib", 2)
    point = {"attributes": [attr("k", stringValue="v")], "startTimeUnixNano": "1000000", "timeUnixNano": "9000000", "asInt": "6"}
    metric = {"resourceMetrics": [{"resource": resource, "scopeMetrics": [{"metrics": [{"name": "hits", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [point]}}]}]}]}
    m = ingest.otlp_metrics(body(spark, metric)).first()
    assert (m.name, m.labels, m.ts, m.start_ts, m.v, m.delta) == ("hits_total", {"k": "v", "job": "shop", "instance": "i1"}, 9, 1, 6.0, True)


def test_zipkin(spark):
    value = [{"traceId": "ab", "id": "1", "name": "get", "kind": "CLIENT", "timestamp": 10, "duration": 5, "localEndpoint": {"serviceName": "web"}, "remoteEndpoint": {"serviceName": "db"}, "tags": {"error": "yes"}, "annotations": [{"timestamp": 12, "value": "ws"}]}]
    s = ingest.zipkin(body(spark, value)).first()
    assert (len(s.trace_id), s.kind, s.start_ns, s.duration_ns, s.status, s.service, s.attrs["peer.service"], s.events[0].time_since_start_ns) == (32, 3, 10_000, 5_000, 2, "web", "db", 2000)


def test_profiles(spark):
    lines = spark.createDataFrame([("main;run;leaf 3",), ("main;run;leaf 4",), ("bad",)], "line string")
    assert [(r.stack, r.value) for r in ingest.folded(lines).collect()] == [(["leaf", "run", "main"], 7)]
    raw = wire.encode_pprof([(["leaf", "main"], 5), (["main"], 2)], ("cpu", "ns"), 7_000_000)
    rows = ingest.pprof(spark.createDataFrame([(raw,)], "body binary")).collect()
    assert [(r.stack, r.value, r.profile_type, r.ts_ms) for r in rows] == [(["leaf", "main"], 5, "cpu:ns::", 7), (["main"], 2, "cpu:ns::", 7)]
    scope = {"shared": {"frames": [{"name": "a"}, {"name": "b"}]}, "profiles": [{"type": "sampled", "name": "p", "unit": "ms", "samples": [[0, 1], [0], [0, 1]], "weights": [1, 2, 3]}]}
    assert {(tuple(r.stack), r.value) for r in ingest.speedscope(body(spark, scope)).collect()} == {(("b", "a"), 4.0), (("a",), 2.0)}


def test_relabel(spark):
    df = spark.createDataFrame([({"job": "Web-1", "__meta_zone": "eu"},), ({"job": "db"},)], "labels map<string,string>")
    rules = [
        {"action": "keep", "source_labels": ["job"], "regex": "Web.*"}, {"source_labels": ["job"], "regex": "(.*)-(\\d)", "target_label": "n", "replacement": "${2}"}, {"action": "labelmap", "regex": "__meta_(.+)"},
        {"action": "labeldrop", "regex": "__.*"}, {"action": "lowercase", "source_labels": ["job"], "target_label": "job"}, {"action": "hashmod", "source_labels": ["job"], "modulus": 1, "target_label": "shard"},
    ]
    assert [r.labels for r in ingest.relabel(df, rules).collect()] == [{"job": "web-1", "n": "1", "zone": "eu", "shard": "0"}]


def test_binary_log_push(spark):
    import pyarrow as pa

    from quadrille.sources import wire

    pair = lambda k, v: wire.put(1, k) + wire.put(2, v)
    entry = lambda s, n, line, meta=(): wire.put(1, wire.put(1, s) + wire.put(2, n)) + wire.put(2, line) + b"".join(wire.put(3, pair(*m)) for m in meta)
    stream = wire.put(1, '{app="x y", q="a\\"b,c"}') + wire.put(2, entry(5, 7, "one", [("pod", "p1")])) + wire.put(2, entry(6, 0, "two"))
    body = pa.compress(wire.put(1, stream), codec="snappy", asbytes=True)
    rows = ingest.log_push(spark.createDataFrame([(bytearray(body),)], "body binary")).collect()
    labels = {"app": "x y", "q": 'a"b,c'}
    assert [(r.labels, r.ts_ns, r.line, r.metadata) for r in rows] == [(labels, 5_000_000_007, "one", {"pod": "p1"}), (labels, 6_000_000_000, "two", {})]
    with pytest.raises(wire.WireError):
        wire.labels_of_text("{a=b}")


def test_profile_push(spark):
    from quadrille.sources import wire

    pair = lambda k, v: wire.put(1, k) + wire.put(2, v)
    profile = wire.encode_pprof([(["leaf", "main"], 5), (["main"], 2)], ("cpu", "ns"), 3_000_000)
    body = wire.put(1, wire.put(1, pair("service", "s")) + wire.put(1, pair("__name__", "process_cpu")) + wire.put(2, wire.put(1, profile) + wire.put(2, "id-1")))
    rows = ingest.profile_push(spark.createDataFrame([(bytearray(body),)], "body binary")).collect()
    assert sorted((r.stack, r.value, r.labels["service"], r.labels["__name__"], r.ts_ms) for r in rows) == [(["leaf", "main"], 5, "s", "process_cpu", 3), (["main"], 2, "s", "process_cpu", 3)]


def test_jaeger(spark):
    import json

    tag = lambda k, t, v: {"key": k, "type": t, "value": v}
    span = {"traceID": "t", "spanID": "b", "operationName": "get", "references": [{"refType": "FOLLOWS_FROM", "traceID": "t", "spanID": "z"}, {"refType": "CHILD_OF", "traceID": "t", "spanID": "a"}], "startTime": 1000, "duration": 25, "processID": "p1", "tags": [tag("span.kind", "string", "client"), tag("error", "bool", True), tag("n", "int64", 7), tag("x", "float64", 1.5), tag("n", "int64", 8)], "logs": [{"timestamp": 1005, "fields": [tag("event", "string", "retry"), tag("why", "string", "slow")]}]}
    doc = {"data": [{"traceID": "t", "processes": {"p1": {"serviceName": "shop", "tags": [tag("host", "string", "h1")]}}, "spans": [span, {"traceID": "t", "spanID": "a", "operationName": "root", "startTime": 990, "duration": 100, "processID": "p1"}]}]}
    rows = {r.span_id: r for r in ingest.jaeger(spark.createDataFrame([(json.dumps(doc),)], "body string")).collect()}
    b = rows["b"]
    assert (b.trace_id, b.parent_span_id, b.name, b.kind, b.start_ns, b.duration_ns, b.status, b.service) == ("t", "a", "get", 3, 1_000_000, 25_000, 2, "shop")
    assert b.attrs == {"span.kind": "client"} and b.nums == {"n": 7.0, "x": 1.5} and b.bools == {"error": True} and b.resource == {"host": "h1"}
    assert [(e.name, e.time_since_start_ns, e.attrs) for e in b.events] == [("retry", 5000, {"why": "slow"})]
    assert rows["a"].parent_span_id is None and rows["a"].kind == 0 and rows["a"].attrs == {} and rows["a"].events == []


def test_write_requests_round_trip(spark, tmp_path):
    from quadrille.sources import sinks

    rows = [("m", {"k": str(k % 7)}, t, float(t * k)) for k in range(20) for t in range(k, k + 3)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, ts long, v double")
    bodies = sinks.write_requests(df, batch=9)
    back = ingest.remote_write(bodies.select("body"))
    key = lambda d: sorted((r.name, sorted(r.labels.items()), r.ts, r.v) for r in d.collect())
    assert key(back) == key(df) and max(r.samples for r in bodies.collect()) <= 9
    folder = str(tmp_path)

    def post(body: bytes) -> None:
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}.bin", "wb") as f:
            f.write(body)

    sinks.send(bodies, post)
    sent = spark.read.format("binaryFile").load(f"{folder}/*.bin").selectExpr("content body")
    assert key(ingest.remote_write(sent)) == key(df)
