"""Recording and alerting rules over time-series queries, and stream jobs: tails of logs and block building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import labels_of
from ..operators.storage import write_blocks
from ..plans import logql, promql
from ..plans.templates import alert_text


def _with(labels: Column, more: dict[str, str]) -> Column:
    """A label map with some labels set; empty values remove."""
    rest = F.map_filter(labels, lambda k, v: ~k.isin("__name__", *more))
    kept = {k: v for k, v in more.items() if v != ""}
    return F.map_concat(rest, F.create_map(*[x for k, v in kept.items() for x in (F.lit(k), F.lit(v))])) if kept else rest


def recording_rule(store: promql.Store, record: str, expr: str, start: int, end: int, step: int, labels: dict[str, str] | None = None, lookback: int = promql.LOOKBACK) -> DataFrame:
    """(name, labels, ts, v): the expression's values as a new metric."""
    df = promql.query_range(store, expr, start, end, step, lookback)
    return df.select(F.lit(record).alias("name"), _with(F.col("labels"), labels or {}).alias("labels"), F.col("ts_ms").alias("ts"), F.col("value").alias("v"))


def alert_states(active: DataFrame, step: int, hold: int = 0, keep_firing: int = 0, end: int | None = None) -> DataFrame:
    """(ls, ts, state, since, v) from the evaluations (ls, ts, v) at which an alert's expression holds.

    Runs of evaluations are pending until they have held for ``hold``, then firing; after its run an alert keeps firing for ``keep_firing``,
    and a run that begins meanwhile fires at once.  v is null where only that keeps it firing.
    """
    w = Window.partitionBy("ls").orderBy("ts")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w) > step).cast("int"), F.lit(0))
    runs = active.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w))
    spans = runs.groupBy("ls", "_run").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    order = Window.partitionBy("ls").orderBy("a")
    apart = F.coalesce((F.col("a") - F.lag("b").over(order) - 2 * step >= keep_firing).cast("int"), F.lit(0))
    chained = spans.withColumn("_apart", apart).withColumn("_chain", F.sum("_apart").over(order))
    fires = F.when(F.col("b") - F.col("a") >= hold, F.col("a") + hold)
    chain = Window.partitionBy("ls", "_chain")
    first = chained.withColumns({"fires": F.min(fires).over(chain), "since": F.min(F.when(fires.isNotNull(), F.struct("a"))).over(chain)["a"], "next": F.lead("a").over(order)})
    own = runs.join(first.select("ls", "_run", "a", "fires", "since"), ["ls", "_run"])
    firing = F.col("fires").isNotNull() & (F.col("ts") >= F.col("fires"))
    rows = own.select("ls", "ts", F.when(firing, "firing").otherwise("pending").alias("state"), F.when(firing, F.col("since")).otherwise(F.col("a")).alias("since"), "v")
    if keep_firing <= 0:
        return rows
    last = F.least(F.col("b") + step + (keep_firing - 1) // step * step, F.coalesce(F.col("next") - step, F.lit(1 << 62)), F.lit(end if end is not None else 1 << 62))
    kept = first.filter(F.col("fires").isNotNull() & (F.col("b") >= F.col("fires"))).withColumn("last", last).filter(F.col("last") > F.col("b"))
    more = kept.select("ls", F.explode(F.sequence(F.col("b") + step, F.col("last"), F.lit(step))).alias("ts"), F.lit("firing").alias("state"), "since", F.lit(None).cast("double").alias("v"))
    return rows.unionByName(more)


def alerting_rule(store: promql.Store, alert: str, expr: str, start: int, end: int, step: int, hold: int = 0, keep_firing: int = 0, labels: dict[str, str] | None = None, lookback: int = promql.LOOKBACK) -> DataFrame:
    """(name, labels, ts, v): ALERTS with the state as a label, and ALERTS_FOR_STATE with the time since when, in seconds."""
    df = promql.query_range(store, expr, start, end, step, lookback)
    states = alert_states(df.select(labels_of(_with(F.col("labels"), {"alertname": alert, **(labels or {})})).alias("ls"), F.col("ts_ms").alias("ts"), F.col("value").alias("v")), step, hold, keep_firing, end)
    m = F.map_from_entries("ls")
    one = F.struct(F.lit("ALERTS").alias("name"), F.map_concat(m, F.create_map(F.lit("alertstate"), F.col("state"))).alias("labels"), F.lit(1.0).alias("v"))
    two = F.struct(F.lit("ALERTS_FOR_STATE").alias("name"), m.alias("labels"), (F.col("since") / 1000.0).alias("v"))
    return states.select("ts", F.explode(F.array(one, two)).alias("r")).select("r.name", "r.labels", "ts", "r.v")


def alerts(store: promql.Store, alert: str, expr: str, start: int, end: int, step: int, hold: int = 0, keep_firing: int = 0, labels: dict[str, str] | None = None, annotations: dict[str, str] | None = None, lookback: int = promql.LOOKBACK) -> DataFrame:
    """(labels, annotations, state, since, ts, value) of the alerts of a rule; labels and annotations are templates over the series' labels and value."""
    df = promql.query_range(store, expr, start, end, step, lookback)
    own, value = F.col("labels"), F.col("value")
    made = lambda texts: F.create_map(*[x for k, t in texts.items() for x in (F.lit(k), alert_text(t, own, value))]) if texts else F.create_map().cast("map<string,string>")
    extra = {"alertname": F.lit(alert)} | {k: alert_text(t, own, value) for k, t in (labels or {}).items()}
    rest = F.map_filter(own, lambda k, v: ~k.isin("__name__", *extra))
    full = F.map_filter(F.map_concat(rest, F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v)])), lambda k, v: v != "")
    rows = df.select(labels_of(full).alias("ls"), F.col("ts_ms").alias("ts"), value.alias("v"), made(annotations or {}).alias("annotations"))
    states = alert_states(rows.select("ls", "ts", "v"), step, hold, keep_firing, end)
    texts = rows.groupBy("ls", "ts").agg(F.first("annotations").alias("annotations"))
    return states.join(texts, ["ls", "ts"], "left").select(F.map_from_entries("ls").alias("labels"), "annotations", "state", "since", "ts", F.col("v").alias("value"))


def tail(logs: DataFrame, text: str, since_ns: int = 0) -> DataFrame:
    """A stream query on a stream of log rows: filters and projections only."""
    node = logql.parse(text)
    if not isinstance(node, logql.Logs) or any(s.kind == "distinct" for s in node.stages):
        raise logql.QueryError("a tail is a stream query without distinct")
    rows = logql.LogCompiler(logs, promql.Grid(0, 0, 1)).rows(node, since_ns - 1, (1 << 63) - 1)
    return rows.select(F.col("lab").alias("labels"), "ts_ns", "line", "err")


def build_blocks(stream: DataFrame, path: str, checkpoint: str, time: str, sort: list[str], day_units: int, **trigger) -> StreamingQuery:
    """Write a stream as sorted blocks, a batch at a time; the batch's number is part of the folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        write_blocks(batch, f"{path}/batch={number}", time, sort, mode="overwrite", day_units=day_units)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
