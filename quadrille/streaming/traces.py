"""Metrics generated from spans: request counts, sizes and latencies, and the service graph.

Both work on tables and on streams.  Service graph edges pair by one grouping on the client's span: a client or producer stands
under its own id, a server or consumer under its parent's, so there is no self-join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spans import KINDS, STATUS, code_name, laid_out

#: Upper bounds of the latency buckets, in seconds.
BUCKETS = (0.002, 0.004, 0.008, 0.016, 0.032, 0.064, 0.128, 0.256, 0.512, 1.02, 2.05, 4.10)
CLIENT, SERVER, PRODUCER, CONSUMER = 3, 2, 4, 5


def _dimension(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.col("resource")[name], F.lit(""))


def red(spans: DataFrame, dimensions: list[str] = (), buckets: tuple = BUCKETS, watermark: str | None = None, every: str | None = None) -> DataFrame:
    """(service, span_name, span_kind, status_code, dimensions, calls, size, latency_sum, bucket counts).

    ``size`` and ``multiplier`` columns of the spans are used if there.  On a stream with a timestamp column ``ts``, ``watermark`` and
    ``every`` give counts by time window.
    """
    df = laid_out(spans)
    weight = F.coalesce(F.col("multiplier"), F.lit(1.0)) if "multiplier" in df.columns else F.lit(1.0)
    size = F.col("size").cast("double") if "size" in df.columns else F.lit(0.0)
    seconds = F.col("duration_ns") / 1e9
    keys = [F.coalesce("service", F.lit("")).alias("service"), F.col("name").alias("span_name"), code_name(F.col("kind"), KINDS).alias("span_kind"), code_name(F.col("status"), STATUS).alias("status_code"), *[_dimension(d).alias(d) for d in dimensions]]
    if every:
        df = df.withWatermark("ts", watermark)
        keys.append(F.window("ts", every).alias("window"))
    counts = [F.sum(F.when(seconds <= b, weight).otherwise(0.0)).alias(f"le_{k}") for k, b in enumerate(buckets)]
    return df.groupBy(*keys).agg(F.sum(weight).alias("calls"), F.sum(size * weight).alias("size"), F.sum(seconds * weight).alias("latency_sum"), *counts)


def capped(counts: DataFrame, spans: DataFrame, max_series: int) -> tuple[DataFrame, DataFrame]:
    """The series that were seen first, ``max_series`` of them, and (discarded) the number of spans of the others."""
    keys = ["service", "span_name"]
    first = spans.groupBy("service", F.col("name").alias("span_name")).agg(F.min("start_ns").alias("t"), F.count(F.lit(1)).alias("n"))
    ranked = first.orderBy("t", "service", "span_name").limit(max_series).select(*keys)
    return counts.join(ranked, keys, "left_semi"), first.join(ranked, keys, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("discarded"))


def red_samples(counts: DataFrame, ts: int, dimensions: list[str] = (), buckets: tuple = BUCKETS) -> DataFrame:
    """The counts as samples (name, labels, ts, v)."""
    names = ["service", "span_name", "span_kind", "status_code", *dimensions]
    base = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v != "")
    one = lambda name, v, le=None: F.struct(F.lit(name).alias("name"), (base if le is None else F.map_concat(base, F.create_map(F.lit("le"), F.lit(le)))).alias("labels"), v.alias("v"))
    prefix = "traces_spanmetrics_"
    rows = [one(prefix + "calls_total", F.col("calls")), one(prefix + "size_total", F.col("size")), one(prefix + "latency_sum", F.col("latency_sum")), one(prefix + "latency_count", F.col("calls"))]
    rows += [one(prefix + "latency_bucket", F.col(f"le_{k}"), repr(b)) for k, b in enumerate(buckets)] + [one(prefix + "latency_bucket", F.col("calls"), "+Inf")]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.name", "r.labels", F.lit(ts).alias("ts"), "r.v")


def target_info(spans: DataFrame, ts: int) -> DataFrame:
    """One info sample for each service and its resource attributes."""
    df = laid_out(spans)
    labels = F.map_concat(F.create_map(F.lit("service"), F.coalesce("service", F.lit(""))), F.coalesce(F.map_filter("resource", lambda k, v: ~k.isin("service", "service.name")), F.create_map().cast("map<string,string>")))
    ls = F.array_sort(F.map_entries(labels))
    return df.select(ls.alias("ls")).distinct().select(F.lit("traces_target_info").alias("name"), F.map_from_entries("ls").alias("labels"), F.lit(ts).alias("ts"), F.lit(1.0).alias("v"))


# --- service graph
HALF = "trace_id string, edge_id string, is_client boolean, service string, seconds double, failed boolean, connection string, peer string, seen_ns long"


def halves(spans: DataFrame, peer_attributes: list[str] = ("peer.service", "db.name", "db.system")) -> DataFrame:
    """One row for each span that can be a side of an edge."""
    df = laid_out(spans).filter(F.col("kind").isin(CLIENT, PRODUCER) | (F.col("kind").isin(SERVER, CONSUMER) & F.col("parent_span_id").isNotNull()))
    client = F.col("kind").isin(CLIENT, PRODUCER)
    has = lambda k: F.coalesce(F.map_contains_key("attrs", F.lit(k)), F.lit(False))
    connection = F.when(has("db.system"), "database").when(has("messaging.system"), "messaging_system").when(has("peer.service"), "virtual_node").otherwise("")
    return df.select(
        F.col("trace_id").cast("string").alias("trace_id"), F.when(client, F.col("span_id")).otherwise(F.col("parent_span_id")).cast("string").alias("edge_id"), client.alias("is_client"),
        F.coalesce("service", F.lit("")).alias("service"), (F.greatest("duration_ns", F.lit(0)) / 1e9).alias("seconds"), (F.col("status") == 2).alias("failed"), connection.alias("connection"),
        F.coalesce(*[F.col("attrs")[p] for p in peer_attributes]).alias("peer"), F.col("start_ns").alias("seen_ns"),
    )


def edges(spans: DataFrame, ttl_ns: int | None = None, **options) -> DataFrame:
    """(client, server, connection, failed, client_seconds, server_seconds, state): complete, virtual or unpaired edges.

    With ``ttl_ns``, sides that start further apart do not meet.
    """
    h = halves(spans, **options)
    side = lambda c, name: F.min(F.when(F.col("is_client") == c, F.col(name)))
    g = h.groupBy("trace_id", "edge_id").agg(
        side(True, "service").alias("client"), side(False, "service").alias("server"), side(True, "seconds").alias("client_seconds"), side(False, "seconds").alias("server_seconds"),
        F.max("failed").alias("failed"), F.max("connection").alias("connection"), F.max(F.when(F.col("connection") == "virtual_node", F.col("peer"))).alias("peer"),
        (F.max("seen_ns") - F.min("seen_ns")).alias("apart"),
    )
    late = F.lit(False) if ttl_ns is None else F.col("apart") > ttl_ns
    both = F.col("client").isNotNull() & F.col("server").isNotNull() & ~late
    state = F.when(both, "complete").when(F.col("peer").isNotNull(), "virtual").otherwise("unpaired")
    named = g.withColumn("state", state)
    peer = lambda own, other: F.when((F.col("state") == "virtual") & F.col(own).isNull(), F.col("peer")).otherwise(F.col(own))
    return named.select(peer("client", "server").alias("client"), peer("server", "client").alias("server"), "connection", "failed", "client_seconds", "server_seconds", "state")


def graph(found: DataFrame, buckets: tuple = BUCKETS) -> DataFrame:
    """(client, server, connection, requests, failed, client and server latency sums, bucket counts of the server's) of finished edges."""
    done = found.filter("state <> 'unpaired'")
    le = [F.sum((F.col("server_seconds") <= b).cast("long")).alias(f"le_{k}") for k, b in enumerate(buckets)]
    return done.groupBy("client", "server", "connection").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("failed").cast("long")).alias("failed"), F.sum("client_seconds").alias("client_seconds"), F.sum("server_seconds").alias("server_seconds"), *le
    )


EDGE = "client string, server string, connection string, failed boolean, client_seconds double, server_seconds double, state string"
STATE = "client string, server string, connection string, failed boolean, client_seconds double, server_seconds double, peer string"


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """One edge: sides wait for each other in state, for ``ttl_ms`` at most."""
    names = ["client", "server", "connection", "failed", "client_seconds", "server_seconds", "peer"]
    edge = dict(zip(names, state.get, strict=True)) if state.exists else dict.fromkeys(names)
    row = lambda s: pd.DataFrame([{**{n: edge[n] for n in names[:-1]}, "connection": edge["connection"] or "", "failed": bool(edge["failed"]), "state": s}])
    if state.hasTimedOut:
        state.remove()
        virtual = edge["peer"] is not None
        if virtual:
            edge["client"], edge["server"] = edge["client"] or edge["peer"], edge["server"] or edge["peer"]
        yield row("virtual" if virtual else "unpaired")
        return
    for frame in frames:
        for r in frame.itertuples():
            side = "client" if r.is_client else "server"
            edge[side], edge[f"{side}_seconds"] = r.service, float(r.seconds)
            edge["failed"] = bool(edge["failed"]) or bool(r.failed)
            edge["connection"] = r.connection or edge["connection"]
            if r.connection == "virtual_node" and isinstance(r.peer, str):
                edge["peer"] = r.peer
    if edge["client"] is not None and edge["server"] is not None:
        if state.exists:
            state.remove()
        yield row("complete")
        return
    state.update(tuple(edge[n] for n in names))
    state.setTimeoutDuration(ttl_ms)


def stream_edges(spans: DataFrame, ttl_ms: int = 10_000, **options) -> DataFrame:
    """Edges of a stream of spans, as they complete or expire."""
    return halves(spans, **options).groupBy("trace_id", "edge_id").applyInPandasWithState(partial(_pair, ttl_ms=ttl_ms), EDGE, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


# --- delta to cumulative
def cumulative(deltas: DataFrame) -> DataFrame:
    """Points (series, ts, start_ts, v) of delta sums as running totals, which start anew when the start time changes.

    A start time of 0 is unknown: the last known one holds.
    """
    w = Window.partitionBy("series").orderBy("ts", "start_ts")
    before = F.last(F.when(F.col("start_ts") != 0, F.col("start_ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("start_ts") != 0) & before.isNotNull() & (before != F.col("start_ts"))
    numbered = deltas.withColumn("_run", F.coalesce(fresh, F.lit(False)).cast("int"))
    runs = numbered.withColumn("_run", F.sum("_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("v").over(Window.partitionBy("series", "_run").orderBy("ts", "start_ts").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("v", total).drop("_run")


def _accumulate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    start, total = state.get if state.exists else (0, 0.0)
    out = []
    for r in pd.concat(list(frames)).sort_values(["ts", "start_ts"]).itertuples():
        total = r.v if r.start_ts and start and r.start_ts != start else total + r.v
        start = r.start_ts or start
        out.append((key[0], r.ts, r.start_ts, total))
    state.update((int(start), float(total)))
    state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=["series", "ts", "start_ts", "v"])


def stream_cumulative(deltas: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """The same on a stream; a series that is silent for ``idle_ms`` is forgotten."""
    return deltas.groupBy("series").applyInPandasWithState(partial(_accumulate, idle_ms=idle_ms), "series string, ts long, start_ts long, v double", "start_ts long, v double", "append", GroupStateTimeout.ProcessingTimeTimeout)
