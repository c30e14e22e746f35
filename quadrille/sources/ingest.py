"""Decoders from raw records to signal rows.  Text and JSON formats are built-in expressions; binary ones decode in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wire

SAMPLES = "labels map<string,string>, ts long, v double"


def named(samples: DataFrame) -> DataFrame:
    """(name, labels, ts, v) from labels that hold the name."""
    return samples.select(F.col("labels")["__name__"].alias("name"), F.map_filter("labels", lambda k, v: k != "__name__").alias("labels"), "ts", "v")


def remote_write(bodies: DataFrame, version: int = 1) -> DataFrame:
    """Samples of write requests in a column ``body``."""
    decode = wire.remote_write_v1 if version == 1 else wire.remote_write_v2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                rows = decode(body.as_py())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([[*r[0].items()] for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["labels", "ts", "v"])

    return named(bodies.select("body").mapInArrow(run, SAMPLES))


def xor_chunks(chunks: DataFrame) -> DataFrame:
    """(labels, ts, v) of rows (labels, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for labels, chunk in zip(batch.column(0), batch.column(1), strict=True):
                rows = wire.xor_chunk(chunk.as_py())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([labels.as_py()] * len(rows), pa.map_(pa.string(), pa.string())), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["labels", "ts", "v"])

    return chunks.select("labels", "chunk").mapInArrow(run, SAMPLES)


def influx(lines: DataFrame) -> DataFrame:
    """Samples of line protocol in a column ``line``: one for each field, named measurement_field; text fields are left out, times are ns."""
    esc = lambda c: F.regexp_replace(c, r"\\([,= ])", "$1")
    token = r"(?:\\.|[^\\, =])+"
    shape = rf"^({token})((?:,{token}={token})*) (.+?)(?: (-?\d+))?\s*$"
    raw = F.col("line")
    ok = lines.filter(raw.rlike(shape) & ~raw.startswith("#"))
    pair = lambda t: F.struct(esc(F.regexp_extract(t, rf"^({token})=", 1)).alias("k"), F.regexp_replace(t, rf"^{token}=", "").alias("v"))
    tags = F.transform(F.regexp_extract_all(F.regexp_extract(raw, shape, 2), F.lit(rf"{token}={token}"), 0), pair)
    values = F.transform(F.regexp_extract_all(F.regexp_extract(raw, shape, 3), F.lit(rf'{token}=(?:"(?:[^"\\]|\\.)*"|[^,]+)'), 0), pair)
    parsed = ok.select(esc(F.regexp_extract(raw, shape, 1)).alias("m"), F.map_from_entries(F.transform(tags, lambda e: F.struct(e["k"], esc(e["v"])))).alias("labels"), F.regexp_extract(raw, shape, 4).alias("t"), F.explode(values).alias("f"))
    text = F.col("f.v")
    number = F.when(text.isin("t", "T", "true", "True", "TRUE"), 1.0).when(text.isin("f", "F", "false", "False", "FALSE"), 0.0).otherwise(F.regexp_replace(text, "[iu]$", "").try_cast("double"))
    name = F.when(F.col("f.k") == "value", F.col("m")).otherwise(F.concat_ws("_", "m", "f.k"))
    out = parsed.select(F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_").alias("name"), "labels", F.expr("try_cast(t as bigint) div 1000000").alias("ts"), number.alias("v"))
    return out.filter("v is not null")


LOKI = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"


def loki_push(bodies: DataFrame) -> DataFrame:
    """Log rows of push requests in JSON, in a column ``body``; a third element of a value is structured metadata."""
    streams = bodies.select(F.explode(F.from_json("body", LOKI)["streams"]).alias("s")).select("s.stream", F.explode("s.values").alias("v"))
    meta = F.coalesce(F.from_json(F.get("v", 2), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return streams.select(F.col("stream").alias("labels"), F.get("v", 0).cast("long").alias("ts_ns"), F.get("v", 1).alias("line"), meta.alias("metadata"))


def log_push(bodies: DataFrame) -> DataFrame:
    """Log rows of binary push requests in a column ``body``."""
    text = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                rows = [([*labels.items()], ns, line, [*meta.items()]) for labels, ns, line, meta in wire.log_push(body.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (text, pa.int64(), pa.string(), text), strict=True)], ["labels", "ts_ns", "line", "metadata"])

    return bodies.select("body").mapInArrow(run, "labels map<string,string>, ts_ns long, line string, metadata map<string,string>")


JAEGER = (
    "data array<struct<processes:map<string,struct<serviceName:string,tags:array<struct<key:string,type:string,value:string>>>>,spans:array<struct<traceID:string,spanID:string,operationName:string,"
    "references:array<struct<refType:string,traceID:string,spanID:string>>,startTime:bigint,duration:bigint,processID:string,tags:array<struct<key:string,type:string,value:string>>,"
    "logs:array<struct<timestamp:bigint,fields:array<struct<key:string,type:string,value:string>>>>>>>>"
)


def jaeger(bodies: DataFrame) -> DataFrame:
    """Spans of trace listings in JSON, in a column ``body``; times there are microseconds.

    The parent is the first reference of type CHILD_OF to the same trace; span.kind, error and otel.status_code give kind and status.
    """
    t = bodies.select(F.explode(F.from_json("body", JAEGER)["data"]).alias("d")).select("d.processes", F.explode("d.spans").alias("s")).withColumn("p", F.col("processes")[F.col("s.processID")])
    of = lambda tags, kinds: F.filter(F.coalesce(tags, F.array()), lambda e: e["type"].isin(*kinds))
    entry = lambda tags, cast: F.map_from_entries(F.transform(_first_of_keys(tags), lambda e: F.struct(e["key"].alias("k"), cast(e["value"]).alias("v"))))
    tags, text, numbers = F.col("s.tags"), ("string", "binary"), ("int64", "float64")
    attrs = entry(of(tags, text), lambda v: v)
    parent = F.get(F.filter("s.references", lambda r: (r["refType"] == "CHILD_OF") & (r["traceID"] == F.col("s.traceID"))), 0)["spanID"]
    kind = F.array_position(F.array(*[F.lit(k) for k in ("internal", "server", "client", "producer", "consumer")]), F.coalesce(attrs["span.kind"], F.lit("")))
    bools = entry(of(tags, ("bool",)), lambda v: v.try_cast("boolean"))
    status = F.when(F.coalesce(bools["error"], F.lit(False)) | (F.upper(F.coalesce(attrs["otel.status_code"], F.lit(""))) == "ERROR"), 2).when(F.upper(F.coalesce(attrs["otel.status_code"], F.lit(""))) == "OK", 1).otherwise(0)
    named = lambda fields: F.coalesce(F.get(F.filter(fields, lambda f: f["key"] == "event"), 0)["value"], F.lit(""))
    rest = lambda fields: entry(F.filter(fields, lambda f: f["key"] != "event"), lambda v: v)
    events = F.transform(F.coalesce("s.logs", F.array()), lambda e: F.struct(named(e["fields"]).alias("name"), ((e["timestamp"] - F.col("s.startTime")) * 1000).alias("time_since_start_ns"), rest(e["fields"]).alias("attrs")))
    return t.select(
        F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), parent.alias("parent_span_id"), F.col("s.operationName").alias("name"), kind.cast("int").alias("kind"), (F.col("s.startTime") * 1000).alias("start_ns"),
        (F.col("s.duration") * 1000).alias("duration_ns"), status.alias("status"), F.col("p.serviceName").alias("service"), attrs.alias("attrs"), entry(of(tags, numbers), lambda v: v.try_cast("double")).alias("nums"), bools.alias("bools"),
        entry(F.coalesce("p.tags", F.array()), lambda v: v).alias("resource"), events.alias("events"),
    )


def _first_of_keys(entries: Column) -> Column:
    return F.filter(entries, lambda e, k: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == k + 1)


VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
ATTRS = f"array<struct<key:string,value:{VALUE}>>"
OTLP_LOGS = f"resourceLogs array<struct<resource:struct<attributes:{ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,severityText:string,body:{VALUE},attributes:{ATTRS},traceId:string,spanId:string>>>>>>"
OTLP_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int,message:string>,attributes:{ATTRS},events:array<struct<name:string,timeUnixNano:string,attributes:{ATTRS}>>,links:array<struct<traceId:string,spanId:string,attributes:{ATTRS}>>>"
OTLP_TRACES = f"resourceSpans array<struct<resource:struct<attributes:{ATTRS}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{OTLP_SPAN}>>>>>"
POINTS = f"array<struct<attributes:{ATTRS},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string>>"
OTLP_METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{ATTRS}>,scopeMetrics:array<struct<metrics:array<struct<name:string,unit:string,gauge:struct<dataPoints:{POINTS}>,sum:struct<aggregationTemporality:int,isMonotonic:boolean,dataPoints:{POINTS}>>>>>>>"


def any_text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def text_attrs(a: Column) -> Column:
    """All attributes as strings."""
    return F.map_from_entries(F.filter(F.transform(F.coalesce(a, F.array().cast(ATTRS)), lambda e: F.struct(e["key"], any_text(e["value"]))), lambda e: e["col2"].isNotNull()))


def typed_attrs(a: Column) -> tuple[Column, Column, Column]:
    """(strings, numbers, booleans)."""
    a = F.coalesce(a, F.array().cast(ATTRS))
    pick = lambda f: F.map_from_entries(F.transform(F.filter(a, lambda e: f(e["value"]).isNotNull()), lambda e: F.struct(e["key"], f(e["value"]))))
    return pick(lambda v: v["stringValue"]), pick(lambda v: F.coalesce(v["intValue"].cast("double"), v["doubleValue"])), pick(lambda v: v["boolValue"])


def label_name(k: Column) -> Column:
    return F.regexp_replace(k, "[^a-zA-Z0-9_]", "_")


def otlp_logs(bodies: DataFrame) -> DataFrame:
    r = bodies.select(F.explode(F.from_json("body", OTLP_LOGS)["resourceLogs"]).alias("r")).select(text_attrs(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeLogs").alias("s")).select("res", F.explode("s.logRecords").alias("l"))
    meta = F.map_concat(F.transform_keys(text_attrs(F.col("l.attributes")), lambda k, v: label_name(k)), F.map_filter(F.create_map(F.lit("severity_text"), F.col("l.severityText"), F.lit("trace_id"), F.col("l.traceId"), F.lit("span_id"), F.col("l.spanId")), lambda k, v: v.isNotNull() & (v != "")))
    return r.select(F.transform_keys("res", lambda k, v: label_name(k)).alias("labels"), F.col("l.timeUnixNano").cast("long").alias("ts_ns"), F.coalesce(any_text(F.col("l.body")), F.lit("")).alias("line"), meta.alias("metadata"))


def otlp_traces(bodies: DataFrame) -> DataFrame:
    r = bodies.select(F.explode(F.from_json("body", OTLP_TRACES)["resourceSpans"]).alias("r")).select(text_attrs(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("x")).select("resource", "x.scope", F.explode("x.spans").alias("s"))
    start = F.col("s.startTimeUnixNano").cast("long")
    strings, numbers, booleans = typed_attrs(F.col("s.attributes"))
    none = lambda t: F.array().cast(t)
    events = F.transform("s.events", lambda e: F.struct(e["name"].alias("name"), (e["timeUnixNano"].cast("long") - start).alias("time_since_start_ns"), text_attrs(e["attributes"]).alias("attrs")))
    links = F.transform("s.links", lambda e: F.struct(e["traceId"].alias("trace_id"), e["spanId"].alias("span_id"), text_attrs(e["attributes"]).alias("attrs")))
    return r.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("s.name").alias("name"), F.coalesce("s.kind", F.lit(0)).alias("kind"),
        start.alias("start_ns"), (F.col("s.endTimeUnixNano").cast("long") - start).alias("duration_ns"), F.coalesce("s.status.code", F.lit(0)).alias("status"), F.col("s.status.message").alias("status_message"),
        F.col("resource")["service.name"].alias("service"), F.col("scope.name").alias("instrumentation_name"), F.col("scope.version").alias("instrumentation_version"), strings.alias("attrs"), numbers.alias("nums"), booleans.alias("bools"), "resource",
        F.coalesce(events, none("array<struct<name:string,time_since_start_ns:bigint,attrs:map<string,string>>>")).alias("events"), F.coalesce(links, none("array<struct<trace_id:string,span_id:string,attrs:map<string,string>>>")).alias("links"),
    )


def otlp_metrics(bodies: DataFrame) -> DataFrame:
    """(name, labels, ts, start_ts, v, delta) of gauges and sums; deltas go through the cumulative operator."""
    m = bodies.select(F.explode(F.from_json("body", OTLP_METRICS)["resourceMetrics"]).alias("r")).select(text_attrs(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeMetrics").alias("s")).select("res", F.explode("s.metrics").alias("m"))
    p = m.select("res", "m", F.explode(F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints")).alias("p"))
    job = F.concat_ws("/", F.col("res")["service.namespace"], F.col("res")["service.name"])
    labels = F.map_concat(F.transform_keys(text_attrs(F.col("p.attributes")), lambda k, v: label_name(k)), F.map_filter(F.create_map(F.lit("job"), job, F.lit("instance"), F.coalesce(F.col("res")["service.instance.id"], F.lit(""))), lambda k, v: v != ""))
    total = F.coalesce(F.col("m.sum.isMonotonic"), F.lit(False)) & ~F.col("m.name").endswith("_total")
    name = F.concat(label_name(F.col("m.name")), F.when(total, "_total").otherwise(""))
    ms = lambda c: F.expr(f"coalesce(cast({c} as bigint), 0L) div 1000000")
    return p.select(name.alias("name"), labels.alias("labels"), ms("p.timeUnixNano").alias("ts"), ms("p.startTimeUnixNano").alias("start_ts"), F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double")).alias("v"), F.coalesce(F.col("m.sum.aggregationTemporality") == 1, F.lit(False)).alias("delta"))


ZIPKIN = "array<struct<traceId:string,id:string,parentId:string,name:string,kind:string,timestamp:bigint,duration:bigint,localEndpoint:struct<serviceName:string>,remoteEndpoint:struct<serviceName:string>,tags:map<string,string>,annotations:array<struct<timestamp:bigint,value:string>>>>"


def zipkin(bodies: DataFrame) -> DataFrame:
    s = bodies.select(F.explode(F.from_json("body", ZIPKIN)).alias("s"))
    kind = F.expr("case s.kind when 'SERVER' then 2 when 'CLIENT' then 3 when 'PRODUCER' then 4 when 'CONSUMER' then 5 else 1 end")
    tags = F.coalesce("s.tags", F.create_map().cast("map<string,string>"))
    peer = F.when(F.col("s.remoteEndpoint.serviceName").isNotNull() & ~F.map_contains_key(tags, F.lit("peer.service")), F.create_map(F.lit("peer.service"), F.col("s.remoteEndpoint.serviceName"))).otherwise(F.create_map().cast("map<string,string>"))
    events = F.transform(F.coalesce("s.annotations", F.array().cast("array<struct<timestamp:bigint,value:string>>")), lambda a: F.struct(a["value"].alias("name"), ((a["timestamp"] - F.col("s.timestamp")) * 1000).alias("time_since_start_ns"), F.create_map().cast("map<string,string>").alias("attrs")))
    return s.select(
        F.lpad("s.traceId", 32, "0").alias("trace_id"), F.col("s.id").alias("span_id"), F.nullif(F.col("s.parentId"), F.lit("")).alias("parent_span_id"), F.coalesce("s.name", F.lit("")).alias("name"), kind.alias("kind"),
        (F.col("s.timestamp") * 1000).alias("start_ns"), (F.coalesce("s.duration", F.lit(0)) * 1000).alias("duration_ns"), F.when(F.map_contains_key(tags, F.lit("error")), 2).otherwise(0).alias("status"),
        F.col("s.localEndpoint.serviceName").alias("service"), F.map_concat(tags, peer).alias("attrs"), events.alias("events"),
    )


def folded(lines: DataFrame) -> DataFrame:
    """(stack leaf to root, value) of folded stacks in a column ``line``: frames from the root, a blank, a count."""
    shape = r"^(.+) (\d+)$"
    ok = lines.filter(F.col("line").rlike(shape))
    rows = ok.select(F.reverse(F.split(F.regexp_extract("line", shape, 1), ";")).alias("stack"), F.regexp_extract("line", shape, 2).cast("long").alias("value"))
    return rows.groupBy("stack").agg(F.sum("value").alias("value"))


PROFILE = "stack array<string>, value long, profile_type string, labels map<string,string>, ts_ms long"


def pprof(bodies: DataFrame) -> DataFrame:
    """(stack, value, profile_type, labels, ts_ms) of profiles in a column ``body``: a row for each sample and type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                p = wire.decode_pprof(body.as_py())
                period = ":".join(p["period_type"])
                rows = [(stack, values[k], f"{kind}:{unit}:{period}", [*labels.items()], p["time_nanos"] // 1_000_000) for stack, values, labels in p["samples"] for k, (kind, unit) in enumerate(p["sample_types"]) if values[k]]
                kinds = [pa.list_(pa.string()), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["stack", "value", "profile_type", "labels", "ts_ms"])

    return bodies.select("body").mapInArrow(run, PROFILE)


def profile_push(bodies: DataFrame) -> DataFrame:
    """The same of push requests of profile series; the series' labels join those of the samples, and __name__ stays among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for body in batch.column(0):
                rows = [([*labels.items()], profile) for labels, _, profile in wire.profile_push(body.as_py()) if profile]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], text), pa.array([r[1] for r in rows], pa.binary())], ["series", "body"])

    pushed = bodies.select("body").mapInArrow(run, "series map<string,string>, body binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.string()), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64()]
        for batch in batches:
            for series, body in zip(batch.column(0), batch.column(1), strict=True):
                p = wire.decode_pprof(body.as_py())
                period = ":".join(p["period_type"])
                own = dict(series.as_py())
                rows = [(stack, values[k], f"{kind}:{unit}:{period}", [*(labels | own).items()], p["time_nanos"] // 1_000_000) for stack, values, labels in p["samples"] for k, (kind, unit) in enumerate(p["sample_types"]) if values[k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["stack", "value", "profile_type", "labels", "ts_ms"])

    return pushed.mapInArrow(decode, PROFILE)


SPEEDSCOPE = "shared struct<frames:array<struct<name:string>>>, profiles array<struct<type:string,name:string,unit:string,samples:array<array<int>>,weights:array<double>>>"


def speedscope(bodies: DataFrame) -> DataFrame:
    """(profile, unit, stack leaf to root, value) of sampled speedscope profiles."""
    p = bodies.select(F.from_json("body", SPEEDSCOPE).alias("b")).select("b.shared.frames", F.explode("b.profiles").alias("p")).filter("p.type = 'sampled'")
    s = p.select("frames", "p.name", "p.unit", F.explode(F.arrays_zip("p.samples", "p.weights")).alias("z"))
    stack = F.reverse(F.transform("z.samples", lambda i: F.get("frames", i)["name"]))
    return s.groupBy(F.col("name").alias("profile"), "unit", stack.alias("stack")).agg(F.sum("z.weights").alias("value"))


def jsonl_clocks(bodies: DataFrame) -> DataFrame:
    """Clock readings: one JSON object a row of ``body``, keyed by series and time."""
    kind = "struct<labels:map<string,string>,ts:bigint,offset_ns:bigint,error_ns:bigint,source:string>"
    return bodies.select(F.from_json("body", kind).alias("c")).select("c.*").filter("ts is not null")


def relabel(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Apply relabel rules in turn to ``labels``: replace, keep, drop, keepequal, dropequal, hashmod, labelmap, labeldrop, labelkeep, lowercase, uppercase."""
    for rule in rules:
        action, pattern = rule.get("action", "replace"), f"^(?s:{rule.get('regex', '(.*)')})$"
        source = F.concat_ws(rule.get("separator", ";"), *[F.coalesce(F.col("labels")[k], F.lit("")) for k in rule.get("source_labels", [])]) if rule.get("source_labels") else F.lit("")
        to = re.sub(r"\$\{(\w+)\}", r"$\1", rule.get("replacement", "$1"))
        target = rule.get("target_label", "")
        if action in ("keep", "drop"):
            df = df.filter(source.rlike(pattern) if action == "keep" else ~source.rlike(pattern))
            continue
        if action in ("keepequal", "dropequal"):
            same = source == F.coalesce(F.col("labels")[target], F.lit(""))
            df = df.filter(same if action == "keepequal" else ~same)
            continue
        if action in ("labeldrop", "labelkeep"):
            hit = _names_like(pattern, action == "labelkeep")
            df = df.withColumn("labels", F.map_filter("labels", hit))
            continue
        if action == "labelmap":
            mapped = F.map_from_entries(F.transform(_matching_entries(pattern), _renamed(pattern, to)))
            df = df.withColumn("labels", F.map_concat(_without(mapped), mapped))
            continue
        value = {"replace": lambda: F.regexp_replace(source, pattern, to), "lowercase": lambda: F.lower(source), "uppercase": lambda: F.upper(source), "hashmod": lambda: F.pmod(F.conv(F.substring(F.md5(source), 17, 16), 16, 10).cast("decimal(20,0)"), F.lit(rule.get("modulus", 1)).cast("decimal(20,0)")).cast("string")}[action]()
        when = source.rlike(pattern) if action == "replace" else F.lit(True)
        made = F.map_concat(_without_name(target), F.map_filter(F.create_map(F.lit(target), value), lambda k, v: v != ""))
        df = df.withColumn("labels", F.when(when, made).otherwise(F.col("labels")))
    return df


def _names_like(pattern: str, keep: bool):
    return lambda k, v: k.rlike(pattern) if keep else ~k.rlike(pattern)


def _matching_entries(pattern: str) -> Column:
    return F.filter(F.map_entries("labels"), lambda e: e["key"].rlike(pattern))


def _renamed(pattern: str, to: str):
    return lambda e: F.struct(F.regexp_replace(e["key"], pattern, to), e["value"])


def _without(other: Column) -> Column:
    return F.map_filter("labels", lambda k, v: ~F.map_contains_key(other, k))


def _without_name(name: str) -> Column:
    return F.map_filter("labels", lambda k, v: k != name)
