"""Registered queries of generated metrics, rules, storage upkeep and metadata, with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_metrics as cm
from . import catalog_traces as ct
from .operators import metrics_api, native_histograms, storage
from .sources import signals
from .streaming import rules, traces

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
#: With the test spans' durations in ns, bounds in seconds that split them.
BOUNDS = (1e-7, 2e-7, 4e-7, 1e-4, 2e-4, 4e-4)
LE = ", ".join(f"count(*) FILTER (duration_ns / 1e9 <= {b})::DOUBLE AS le_{k}" for k, b in enumerate(BOUNDS))
CASES["stream_spanmetrics"] = (
    lambda spark, sf_dir: traces.red(signals.spans(spark, sf_dir), ["flag"], BOUNDS).withColumn("latency_sum", F.round("latency_sum", 9)),
    ct.BASE + f"SELECT service, name AS span_name, ['unspecified', 'internal', 'server', 'client'][kind + 1] AS span_kind, CASE status WHEN 1 THEN 'ok' ELSE 'error' END AS status_code, coalesce(flag, '') AS flag, count(*)::DOUBLE AS calls, 0.0::DOUBLE AS size, round(sum(duration_ns / 1e9), 9)::DOUBLE AS latency_sum, {LE} FROM spans GROUP BY ALL",
)
CASES["stream_spanmetrics_samples"] = (
    lambda spark, sf_dir: traces.red_samples(traces.red(signals.spans(spark, sf_dir)), 0).filter("name = 'traces_spanmetrics_calls_total'").select(F.col("labels")["service"].alias("service"), F.col("labels")["span_name"].alias("span_name"), F.col("labels")["span_kind"].alias("span_kind"), F.col("labels")["status_code"].alias("status_code"), "v"),
    ct.BASE + "SELECT service, name AS span_name, ['unspecified', 'internal', 'server', 'client'][kind + 1] AS span_kind, CASE status WHEN 1 THEN 'ok' ELSE 'error' END AS status_code, count(*)::DOUBLE AS v FROM spans GROUP BY ALL",
)
EDGES = ct.BASE + """, h AS (SELECT trace_id, CASE WHEN kind = 3 THEN span_id ELSE parent END AS e, kind = 3 AS c, service, duration_ns / 1e9 AS sec, status = 2 AS failed FROM spans WHERE kind IN (2, 3)),
g AS (SELECT trace_id, e, min(service) FILTER (c) AS client, min(service) FILTER (NOT c) AS server, bool_or(failed) AS failed, min(sec) FILTER (c) AS cs, min(sec) FILTER (NOT c) AS ss FROM h GROUP BY ALL) """
CASES["stream_servicegraph"] = (
    lambda spark, sf_dir: traces.graph(traces.edges(signals.spans(spark, sf_dir)), (1e-7, 2e-7)).withColumns({"client_seconds": F.round("client_seconds", 9), "server_seconds": F.round("server_seconds", 9)}),
    EDGES + "SELECT client, server, '' AS connection, count(*) AS requests, count(*) FILTER (failed) AS failed, round(sum(cs), 9)::DOUBLE AS client_seconds, round(sum(ss), 9)::DOUBLE AS server_seconds, count(*) FILTER (ss <= 1e-7) AS le_0, count(*) FILTER (ss <= 2e-7) AS le_1 FROM g WHERE client IS NOT NULL AND server IS NOT NULL GROUP BY client, server",
)
CASES["stream_servicegraph_unpaired"] = (
    lambda spark, sf_dir: traces.edges(signals.spans(spark, sf_dir)).groupBy("state", F.col("client").isNull().alias("without_client")).agg(F.count(F.lit(1)).alias("n")),
    EDGES + "SELECT CASE WHEN client IS NULL OR server IS NULL THEN 'unpaired' ELSE 'complete' END AS state, client IS NULL AS without_client, count(*) AS n FROM g GROUP BY ALL",
)


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = signals.event_samples(spark, sf_dir)
    return g.select(F.concat_ws("/", "event_type", "user_id").alias("series"), "ts", F.expr(f"ts div {10 * cm.DAY} * {10 * cm.DAY}").alias("start_ts"), "v")


CASES["stream_delta_cumulative"] = (
    lambda spark, sf_dir: traces.cumulative(deltas(spark, sf_dir)).withColumn("v", F.round("v", 6)),
    cm.BASE + f"SELECT event_type || '/' || user_id AS series, ts, (ts // {10 * cm.DAY} * {10 * cm.DAY})::BIGINT AS start_ts, round(sum(v) OVER (PARTITION BY event_type, user_id, ts // {10 * cm.DAY} ORDER BY ts), 6)::DOUBLE AS v FROM gauge",
)
CASES["stream_recording_rule"] = (
    lambda spark, sf_dir: rules.recording_rule(signals.metrics(spark, sf_dir), "event:value:sum", "sum by (event_type) (event_value)", cm.START, cm.END, cm.STEP, {"team": "x"}, cm.DAY).select("name", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["team"].alias("team"), "ts", F.round("v", 6).alias("v")),
    cm.BASE + "SELECT 'event:value:sum' AS name, event_type, 'x' AS team, s AS ts, round(sum(v), 6)::DOUBLE AS v FROM inst GROUP BY event_type, s",
)
CASES["stream_alerting_rule"] = (
    lambda spark, sf_dir: rules.alerting_rule(signals.metrics(spark, sf_dir), "High", "event_value > 60", cm.START, cm.END, cm.STEP, hold=cm.DAY, lookback=cm.DAY).select(
        "name", *[F.col("labels")[k].alias(k) for k in ("event_type", "user_id", "alertname", "alertstate")], "ts", "v"
    ),
    cm.BASE + f""", hot AS (SELECT *, s - row_number() OVER (PARTITION BY event_type, user_id ORDER BY s) * {cm.DAY} AS run FROM inst WHERE v > 60),
r AS (SELECT event_type, user_id, s, min(s) OVER (PARTITION BY event_type, user_id, run) AS since FROM hot)
SELECT 'ALERTS' AS name, event_type, user_id, 'High' AS alertname, CASE WHEN s - since >= {cm.DAY} THEN 'firing' ELSE 'pending' END AS alertstate, s AS ts, 1.0::DOUBLE AS v FROM r
UNION ALL SELECT 'ALERTS_FOR_STATE', event_type, user_id, 'High', NULL, s, (since / 1000.0)::DOUBLE FROM r""",
)


# --- storage
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.read(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), signals.millis("ts").alias("ts"), F.col("value").alias("v"))


E = "SELECT event_id, event_type, user_id::VARCHAR AS user_id, (epoch_us(ts) // 1000)::BIGINT AS ts, value AS v FROM events"
MID = cm.START + 10 * cm.DAY
CASES["storage_compact_dedupe"] = (
    lambda spark, sf_dir: storage.collapse(events(spark, sf_dir).select("event_type", "user_id", F.expr(f"ts div {cm.DAY}").alias("day"), "event_id", "v"), ["event_type", "user_id", "day"], ["event_id"]),
    f"SELECT event_type, user_id, (ts // {cm.DAY})::BIGINT AS day, event_id, v FROM ({E}) QUALIFY row_number() OVER (PARTITION BY event_type, user_id, day ORDER BY event_id) = 1",
)
CASES["storage_hot_cold_merge"] = (
    lambda spark, sf_dir: storage.merge_hot_and_cold(events(spark, sf_dir).filter(f"ts <= {MID}"), events(spark, sf_dir).filter(f"ts > {MID - 2 * cm.DAY}").withColumn("v", -F.col("v")), ["event_id"]),
    f"SELECT event_id, event_type, user_id, ts, CASE WHEN ts > {MID} THEN -v ELSE v END AS v FROM ({E})",
)
CASES["storage_retention"] = (lambda spark, sf_dir: storage.retain(events(spark, sf_dir), "ts", cm.END, 10 * cm.DAY), f"SELECT * FROM ({E}) WHERE ts >= {cm.END - 10 * cm.DAY}")
CASES["storage_erasure"] = (
    lambda spark, sf_dir: storage.erase(events(spark, sf_dir), [(F.col("user_id") == "3", cm.START, MID), (F.col("event_type") == "error", MID, cm.END)], "ts"),
    f"SELECT * FROM ({E}) WHERE NOT (user_id = '3' AND ts BETWEEN {cm.START} AND {MID}) AND NOT (event_type = 'error' AND ts BETWEEN {MID} AND {cm.END})",
)
CASES["storage_audit"] = (
    lambda spark, sf_dir: storage.audit(events(spark, sf_dir).filter("event_id % 7 <> 0").select(F.col("event_id").alias("path")), events(spark, sf_dir).filter("event_id % 5 <> 0").select(F.col("event_id").alias("path"))),
    "SELECT event_id AS path, CASE WHEN event_id % 5 = 0 THEN 'missing' ELSE 'unlisted' END AS state FROM events WHERE (event_id % 7 <> 0) <> (event_id % 5 <> 0)",
)


def tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = signals.metrics(spark, sf_dir).samples.filter("name = 'event_value'")
    gone = samples.filter("labels['event_type'] = 'click'").select(storage.series_key(F.col("labels")).alias("series"), F.lit(cm.START).alias("low"), F.lit(MID).alias("high")).distinct()
    return storage.without_tombstones(samples, gone).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), "ts", "v")


CASES["storage_tombstones"] = (tombstoned, cm.BASE + f"SELECT event_type, user_id, ts, v FROM gauge WHERE NOT (event_type = 'click' AND ts BETWEEN {cm.START} AND {MID})")


# --- metadata
def api(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    CASES[f"metrics_{name}"] = (lambda spark, sf_dir: run(signals.metrics(spark, sf_dir).samples), cm.BASE + sql)


S = ", ser AS (SELECT DISTINCT event_type, user_id FROM gauge)"
api("series", lambda d: metrics_api.series(d, 'event_value{user_id=~"1|2"}').select("name", *[F.col("labels")[k].alias(k) for k in cm.BOTH]), S + " SELECT 'event_value' AS name, event_type, user_id FROM ser WHERE user_id IN ('1', '2')")
api("label_names", metrics_api.label_names, " SELECT unnest(['__name__', 'event_type', 'user_id', 'flag', 'le', 'tier']) AS name")
api("label_values", lambda d: metrics_api.label_values(d, "event_type"), " SELECT DISTINCT event_type AS value FROM gauge")
api("label_cardinality", lambda d: metrics_api.label_cardinality(d.filter("name = 'event_value'")), S + " SELECT 'event_type' AS label, (SELECT count(DISTINCT event_type) FROM ser) AS values, (SELECT count(*) FROM ser)::BIGINT AS series UNION ALL SELECT 'user_id', (SELECT count(DISTINCT user_id) FROM ser), (SELECT count(*) FROM ser)::BIGINT")
api("value_cardinality", lambda d: metrics_api.value_cardinality(d, "event_type"), S + " SELECT event_type AS value, count(*) * 2 AS series FROM ser GROUP BY event_type")
api("active_series", lambda d: metrics_api.active_series(d, 'event_value{event_type!="view"}', MID, 2 * cm.DAY), f" SELECT 'event_value' AS name, count(DISTINCT (event_type, user_id)) AS series FROM gauge WHERE event_type <> 'view' AND ts > {MID - 2 * cm.DAY} AND ts <= {MID}")
api("head_stats", lambda d: metrics_api.head_stats(d.filter("name = 'event_value'")), " SELECT count(DISTINCT (event_type, user_id)) AS series, count(*) AS samples, min(ts) AS min_ts, max(ts) AS max_ts FROM gauge")
api("search_names", lambda d: metrics_api.search_names(d.select("name").distinct(), "event", fuzzy=False), " SELECT unnest(['event_counter', 'event_value']) AS name, 1.0::DOUBLE AS score")
api("exemplars", lambda d: metrics_api.exemplars(d.filter("v > 200").withColumn("trace_id", F.hex("ts")), 'event_value{event_type="click"}', cm.START, MID).select("trace_id", "ts", "v"), f" SELECT to_hex(ts) AS trace_id, ts, v FROM gauge WHERE v > 200 AND event_type = 'click' AND ts BETWEEN {cm.START} AND {MID}")
api("last_per_series", lambda d: storage.latest_per_series(d.filter("name = 'event_value'")).select(F.get("ls", 0)["v"].alias("event_type"), F.get("ls", 1)["v"].alias("user_id"), "ts", "v"), " SELECT event_type, user_id, max(ts) AS ts, arg_max(v, ts) AS v FROM gauge GROUP BY ALL")
api("shard", lambda d: storage.shard(d.filter("name = 'event_value'"), F.col("labels"), 1, 4).groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("n")), " SELECT event_type, count(*) AS n FROM gauge WHERE ('0x' || md5(concat('event_type', chr(30), event_type, chr(31), 'user_id', chr(30), user_id))[1:8])::BIGINT % 4 = 1 GROUP BY event_type")


# --- native histograms
def native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers of two of the events' values, by type and parity of the user."""
    ev = signals.read(spark, sf_dir, "events").filter("value > 0").select("event_type", F.expr("user_id % 2").alias("odd"), F.ceil(F.log2("value")).cast("int").alias("i"), "value")
    by = ev.groupBy("event_type", "odd", "i").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s"))
    return by.groupBy("event_type", "odd").agg(
        F.lit(0).alias("schema"), F.lit(0.0).alias("zero_threshold"), F.lit(0.0).alias("zero_count"), F.sum("n").alias("count"), F.sum("s").alias("sum"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("pos"),
        F.create_map().cast("map<int,double>").alias("neg"), F.lit(None).cast("array<double>").alias("custom"),
    )


NH = "WITH b AS (SELECT event_type, ceil(log2(value))::INT AS i, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY i) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b) "
CASES["promql_native_histogram_quantile"] = (
    lambda spark, sf_dir: native_histograms.quantile(native_histograms.merge(native(spark, sf_dir), ["event_type"]), ["event_type"], 0.7).withColumn("v", F.round("v", 6)),
    NH + "SELECT event_type, round(pow(2, i - 1 + (0.7 * total - upto + n) / n), 6)::DOUBLE AS v FROM c WHERE upto >= 0.7 * total AND upto - n < 0.7 * total",
)
CASES["promql_native_histogram_fraction"] = (
    lambda spark, sf_dir: native_histograms.fraction(native_histograms.merge(native(spark, sf_dir), ["event_type"]), ["event_type"], 0, 48).withColumn("v", F.round("v", 6)),
    NH + "SELECT event_type, round(sum(CASE WHEN i <= 5 THEN n WHEN i = 6 THEN n * (log2(48) - 5) ELSE 0 END) / max(total), 6)::DOUBLE AS v FROM c GROUP BY event_type",
)
CASES["promql_native_histogram_avg"] = (
    lambda spark, sf_dir: native_histograms.accessor(native_histograms.merge(native(spark, sf_dir), ["event_type"]), ["event_type"], "avg").withColumn("v", F.round("v", 6)),
    "SELECT event_type, round(avg(value), 6)::DOUBLE AS v FROM events WHERE value > 0 GROUP BY event_type",
)
