"""Registered log queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import log_analytics
from .plans import logql
from .sources import signals

DAY = 86_400_000
START, END, STEP = 1704067200000, 1706659200000, DAY
LO, HI = START * 1_000_000, END * 1_000_000
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
#: Events as logfmt (a) and JSON (j) lines with what the lines say.
BASE = f"""
WITH ev AS (
  SELECT event_id, event_type, user_id, epoch_us(ts) * 1000 AS ts_ns, value, round(value, 2) AS val, (event_id % 500)::BIGINT AS took, (event_id % 7)::BIGINT AS size, (event_id % 10)::BIGINT AS k, 'pod-' || (user_id % 5)::VARCHAR AS pod FROM events),
a AS (SELECT *, format('type={{}} user={{}} value={{:.2f}} took={{}}ms size={{}}KB msg="event {{}} done"', event_type, user_id, value, took, size, event_id) AS line FROM ev),
j AS (SELECT *, format('{{{{"type":"{{}}","user":{{}},"value":{{:.2f}},"nested":{{{{"k":{{}}}}}}}}}}', event_type, user_id, value, k) AS line FROM ev),
grid AS (SELECT unnest(range({START}, {END} + 1, {STEP}))::BIGINT AS s),
wa AS (SELECT * FROM a JOIN grid ON ts_ns > (s - {DAY}) * 1000000 AND ts_ns <= s * 1000000),
wj AS (SELECT * FROM j JOIN grid ON ts_ns > (s - {DAY}) * 1000000 AND ts_ns <= s * 1000000)
"""
IN = f"ts_ns >= {LO} AND ts_ns < {HI}"


def stream(name: str, text: str, labels: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = logql.query_logs(signals.log_table(spark, sf_dir), text, LO, HI)
        return df.select("ts_ns", "line", *[F.col("labels")[k].alias(k) for k in labels])

    CASES[f"logql_{name}"] = (run, BASE + sql)


def metric(name: str, text: str, labels: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = logql.query_metrics(signals.log_table(spark, sf_dir), text, START - 1000, END, STEP)
        return df.select(*[F.col("labels")[k].alias(k) for k in labels], "ts_ms", F.round("value", 6).alias("value"))

    CASES[f"logql_{name}"] = (run, BASE + sql)


L = f"SELECT ts_ns, line FROM a WHERE {IN} AND "
stream("contains_filter", '{app="logfmt"} |= "type=click" != "user=1 "', [], L + "contains(line, 'type=click') AND NOT contains(line, 'user=1 ')")
stream("or_filter", '{app="logfmt"} |= "type=click" or "type=view"', [], L + "(contains(line, 'type=click') OR contains(line, 'type=view'))")
stream("regex_filter", '{app="logfmt"} |~ "took=[0-9]ms" !~ "user=(2|3) "', [], L + "regexp_matches(line, 'took=[0-9]ms') AND NOT regexp_matches(line, 'user=(2|3) ')")
stream("pattern_filter", '{app="logfmt"} |> "<_> took=1<_>ms <_>" !> "<_>size=3KB<_>"', [], L + "line LIKE '% took=1%ms %' AND line NOT LIKE '%size=3KB%'")
stream("stream_matchers", '{app=~"log.*", event_type!="click", nothing!~"x"}', ["event_type"], f"SELECT ts_ns, line, event_type FROM a WHERE {IN} AND event_type <> 'click'")
stream("ip_filter", '{app="logfmt"} | label_format addr="10.0.0.{{.pod}}" | label_format addr=`{{ trimPrefix "10.0.0.pod-" .addr }}` | line_format "from 10.0.0.{{.addr}} end" |= ip("10.0.0.2-10.0.0.3")', [], f"SELECT ts_ns, 'from 10.0.0.' || (user_id % 5)::VARCHAR || ' end' AS line FROM a WHERE {IN} AND user_id % 5 IN (2, 3)")
stream("logfmt_parser", '{app="logfmt"} | logfmt | took > 450ms and value < 100 | size >= 3KB', ["type", "took", "msg"], f"SELECT ts_ns, line, event_type AS type, took::VARCHAR || 'ms' AS took, 'event ' || event_id::VARCHAR || ' done' AS msg FROM a WHERE {IN} AND took > 450 AND val < 100 AND size >= 3")
stream("logfmt_fields", '{app="logfmt"} | logfmt kind="type", user | user = "3"', ["kind", "user"], f"SELECT ts_ns, line, event_type AS kind, user_id::VARCHAR AS user FROM a WHERE {IN} AND user_id = 3")
stream("json_parser", '{app="json"} | json | nested_k >= 7 or type = "view"', ["type", "nested_k", "user"], f"SELECT ts_ns, line, event_type AS type, k::VARCHAR AS nested_k, user_id::VARCHAR AS user FROM j WHERE {IN} AND (k >= 7 OR event_type = 'view')")
stream("json_fields", '{app="json"} | json deep="nested.k", who="user"', ["deep", "who"], f"SELECT ts_ns, line, k::VARCHAR AS deep, user_id::VARCHAR AS who FROM j WHERE {IN}")
stream("json_error", '{app="logfmt"} | json | __error__ = "JSONParserErr"', [], f"SELECT ts_ns, line FROM a WHERE {IN}")
stream("json_extracted", '{app="json"} | json event_type="type"', ["event_type", "event_type_extracted"], f"SELECT ts_ns, line, event_type, event_type AS event_type_extracted FROM j WHERE {IN}")
DEEP = '{"a":{"b":{"c":{"d":{"e":"{{.k}}"}}}},"a_b":{"k":"{{.pod}}"},"a.b_k":"later","s":"{\\"x\\":1}"}'
stream("json_deep", '{app="json"} | json | label_format k="{{.nested_k}}" | line_format `' + DEEP + "` | drop nested_k, k, type, user, value | json", ["a_b_c_d_e", "a_b_k", "s"], f"SELECT ts_ns, format('{{{{\"a\":{{{{\"b\":{{{{\"c\":{{{{\"d\":{{{{\"e\":\"{{}}\"}}}}}}}}}}}}}}}},\"a_b\":{{{{\"k\":\"{{}}\"}}}},\"a.b_k\":\"later\",\"s\":\"{{{{\\\"x\\\":1}}}}\"}}}}', k, pod) AS line, k::VARCHAR AS a_b_c_d_e, pod AS a_b_k, '{{\"x\":1}}' AS s FROM j WHERE {IN}")
stream("template_conditions", '{app="logfmt"} | logfmt | line_format `{{ if eq .type "click" }}{{ .user | printf "%4s" }}{{ else if gt (float64 .value) 50.0 }}{{ addf .value 0.5 | printf "%.2f" }}{{ else }}{{ with .size }}{{ trimSuffix "KB" . }}{{ end }}{{ end }}`', [], f"SELECT ts_ns, CASE WHEN event_type = 'click' THEN lpad(user_id::VARCHAR, greatest(4, length(user_id::VARCHAR))::INT, ' ') WHEN val > 50 THEN format('{{:.2f}}', val + 0.5) ELSE size::VARCHAR END AS line FROM a WHERE {IN}")
stream("logfmt_strict", '{app="logfmt"} | line_format `{{ if eq .event_type "view" }}a=1 b="open{{ else }}a=1 bare a-b=2 a.b=3{{ end }}` | logfmt --strict | __error__ = ""', ["a", "a_b"], f"SELECT ts_ns, 'a=1 bare a-b=2 a.b=3' AS line, '1' AS a, '2' AS a_b FROM a WHERE {IN} AND event_type <> 'view'")
stream("regexp_parser", '{app="logfmt"} | regexp "user=(?P<who>[0-9]+) value=(?P<whole>[0-9]+)"', ["who", "whole"], f"SELECT ts_ns, line, user_id::VARCHAR AS who, regexp_extract(line, 'value=([0-9]+)', 1) AS whole FROM a WHERE {IN}")
stream("pattern_parser", '{app="logfmt"} | pattern "type=<kind> user=<_> value=<v> <_>"', ["kind", "v"], f"SELECT ts_ns, line, event_type AS kind, format('{{:.2f}}', value) AS v FROM a WHERE {IN}")
stream("unpack", '{app="json"} | unpack', ["type", "user"], f"SELECT ts_ns, line, event_type AS type, user_id::VARCHAR AS user FROM j WHERE {IN}")
stream("decolorize", '{app="logfmt"} | line_format "\x1b[31m{{.event_type}}\x1b[0m" | decolorize', [], f"SELECT ts_ns, event_type AS line FROM a WHERE {IN}")
stream("line_format", '{app="logfmt"} | logfmt | line_format `{{.type | upper}}-{{ trunc 3 .msg }}-{{ .none | default "x" }}`', [], f"SELECT ts_ns, upper(event_type) || '-eve-x' AS line FROM a WHERE {IN}")
stream("label_format", '{app="logfmt"} | logfmt | label_format kind=type, both="{{.user}}/{{.pod}}"', ["kind", "both", "type"], f"SELECT ts_ns, line, event_type AS kind, user_id::VARCHAR || '/' || pod AS both, NULL::VARCHAR AS type FROM a WHERE {IN}")
stream("drop", '{app="logfmt"} | logfmt | drop msg, type="click"', ["msg", "type", "user"], f"SELECT ts_ns, line, NULL::VARCHAR AS msg, CASE WHEN event_type <> 'click' THEN event_type END AS type, user_id::VARCHAR AS user FROM a WHERE {IN}")
stream("keep", '{app="logfmt"} | logfmt | keep user, type=~"c.*"', ["msg", "type", "user"], f"SELECT ts_ns, line, NULL::VARCHAR AS msg, CASE WHEN event_type LIKE 'c%' THEN event_type END AS type, user_id::VARCHAR AS user FROM a WHERE {IN}")
stream("distinct", '{app="logfmt"} | logfmt | distinct user', ["user"], f"SELECT ts_ns, line, user_id::VARCHAR AS user FROM a WHERE {IN} QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts_ns, line) = 1")
M = "SELECT event_type, s AS ts_ms, round({}, 6)::DOUBLE AS value FROM {} GROUP BY event_type, s"
SUM = "sum by (event_type) ({})"
metric("count_over_time", SUM.format('count_over_time({app="logfmt"} |= "took" [1d])'), ["event_type"], M.format("count(*)", "wa"))
metric("long_count", SUM.format('count_over_time({app="logfmt"}[12d])'), ["event_type"], f"SELECT event_type, s AS ts_ms, count(*)::DOUBLE AS value FROM a JOIN grid ON ts_ns > (s - {12 * DAY}) * 1000000 AND ts_ns <= s * 1000000 GROUP BY ALL")
metric("long_unwrap_max", 'max_over_time({app="logfmt"} | logfmt | unwrap value [12d]) by (event_type)', ["event_type"], f"SELECT event_type, s AS ts_ms, round(max(val), 6)::DOUBLE AS value FROM a JOIN grid ON ts_ns > (s - {12 * DAY}) * 1000000 AND ts_ns <= s * 1000000 GROUP BY ALL")
metric("rate", SUM.format('rate({app="logfmt"}[1d])'), ["event_type"], M.format("count(*) / 86400", "wa"))
metric("bytes_over_time", SUM.format('bytes_over_time({app="logfmt"}[1d])'), ["event_type"], M.format("sum(strlen(line))", "wa"))
metric("bytes_rate", SUM.format('bytes_rate({app="logfmt"}[1d])'), ["event_type"], M.format("sum(strlen(line)) / 86400", "wa"))
metric("series_labels", 'count_over_time({app="logfmt"}[1d])', ["app", "event_type", "pod"], "SELECT 'logfmt' AS app, event_type, pod, s AS ts_ms, count(*)::DOUBLE AS value FROM wa GROUP BY ALL")
for fn, expr in {
    "sum": "sum(val)", "avg": "avg(val)", "min": "min(val)", "max": "max(val)", "stddev": "stddev_pop(val)", "stdvar": "var_pop(val)", "first": "arg_min(val, ts_ns)", "last": "arg_max(val, ts_ns)",
}.items():
    metric(f"unwrap_{fn}", f'{fn}_over_time({{app="logfmt"}} | logfmt | unwrap value [1d]) by (event_type)', ["event_type"], M.format(expr, "wa"))
metric("unwrap_quantile", 'quantile_over_time(0.9, {app="logfmt"} | logfmt | unwrap value [1d]) by (event_type)', ["event_type"], M.format("quantile_cont(val, 0.9)", "wa"))
metric("unwrap_duration", 'sum_over_time({app="logfmt"} | logfmt | unwrap duration(took) [1d]) by (event_type)', ["event_type"], M.format("sum(took) / 1000.0", "wa"))
metric("unwrap_bytes", 'sum_over_time({app="logfmt"} | logfmt | unwrap bytes(size) [1d]) by (event_type)', ["event_type"], M.format("sum(size) * 1000.0", "wa"))
metric("unwrap_json", 'max_over_time({app="json"} | json | unwrap nested_k [1d]) by (event_type)', ["event_type"], M.format("max(k)", "wj"))
metric("rate_unwrap", 'rate({app="logfmt"} | logfmt | unwrap value | __error__="" [1d]) by (event_type)'.replace(") by (event_type)", ")"), ["user"], "SELECT user_id::VARCHAR AS user, s AS ts_ms, round(sum(val) / 86400, 6)::DOUBLE AS value FROM wa GROUP BY user_id, event_id, s")
metric("rate_counter", 'rate_counter({app="logfmt"} | logfmt | unwrap value [1d]) by (event_type)', ["event_type"], ", t AS (SELECT event_type, s, ts_ns, sum(val) AS v FROM wa GROUP BY ALL), p AS (SELECT *, lag(v) OVER (PARTITION BY event_type, s ORDER BY ts_ns) AS pv FROM t) SELECT event_type, s AS ts_ms, round(coalesce(sum(CASE WHEN v < pv THEN v ELSE v - pv END), 0) / 86400, 6)::DOUBLE AS value FROM p GROUP BY event_type, s")
metric("present_over_time", 'present_over_time({app="logfmt"} | drop pod [1d])', ["event_type"], M.format("1", "wa"))
metric("absent_over_time", 'absent_over_time({app="none"}[1d])', ["app"], "SELECT 'none' AS app, s AS ts_ms, 1.0::DOUBLE AS value FROM grid")
metric("offset", SUM.format('count_over_time({app="logfmt"}[1d] offset 2d)'), ["event_type"], f"SELECT event_type, s AS ts_ms, count(*)::DOUBLE AS value FROM a JOIN grid ON ts_ns > (s - {3 * DAY}) * 1000000 AND ts_ns <= (s - {2 * DAY}) * 1000000 GROUP BY ALL")
metric("vector_avg", 'avg by (pod) (count_over_time({app="logfmt"}[1d]))', ["pod"], "SELECT pod, s AS ts_ms, round(avg(n), 6)::DOUBLE AS value FROM (SELECT pod, event_type, s, count(*) AS n FROM wa GROUP BY ALL) GROUP BY pod, s")
TOP = "SELECT event_type, pod, s AS ts_ms, n::DOUBLE AS value FROM (SELECT event_type, pod, s, count(*) AS n FROM wa GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY s ORDER BY n {}, event_type, pod) <= 3"
metric("topk", 'topk(3, count_over_time({app="logfmt"}[1d]))', ["event_type", "pod"], TOP.format("DESC"))
metric("bottomk", 'bottomk(3, count_over_time({app="logfmt"}[1d]))', ["event_type", "pod"], TOP.format("ASC"))
metric("approx_topk", 'approx_topk(3, count_over_time({app="logfmt"}[1d]))', ["event_type", "pod"], TOP.format("DESC"))
metric("count_values", 'count_values("n", count_over_time({app="logfmt"}[1d]))', ["n"], "SELECT n::VARCHAR AS n, s AS ts_ms, count(*)::DOUBLE AS value FROM (SELECT event_type, pod, s, count(*) AS n FROM wa GROUP BY ALL) GROUP BY ALL")
metric("sort", "sort_desc(" + SUM.format('rate({app="logfmt"}[1d])') + ")", ["event_type"], M.format("count(*) / 86400", "wa"))
metric("binary", SUM.format('bytes_over_time({app="logfmt"}[1d])') + " / " + SUM.format('count_over_time({app="logfmt"}[1d])') + " > 10", ["event_type"], M.format("sum(strlen(line)) / count(*)", "wa"))
metric("binary_bool", SUM.format('count_over_time({app="logfmt"}[1d])') + " > bool 60", ["event_type"], M.format("CASE WHEN count(*) > 60 THEN 1 ELSE 0 END", "wa"))
metric("set_unless", SUM.format('count_over_time({app="logfmt"}[1d])') + ' unless sum by (event_type) (count_over_time({app="json", event_type=~"c.*"}[1d]))', ["event_type"], "SELECT event_type, s AS ts_ms, count(*)::DOUBLE AS value FROM wa WHERE event_type NOT LIKE 'c%' GROUP BY ALL")
metric("vector", SUM.format('count_over_time({app="none"}[1d])') + " or vector(0)", [], "SELECT s AS ts_ms, 0.0::DOUBLE AS value FROM grid")
metric("label_replace", 'label_replace(' + SUM.format('count_over_time({app="logfmt"}[1d])') + ', "first", "$1", "event_type", "(.).*")', ["event_type", "first"], "SELECT event_type, event_type[1:1] AS first, s AS ts_ms, count(*)::DOUBLE AS value FROM wa GROUP BY ALL")
metric("variants", 'variants(sum by (event_type) (count_over_time({app="logfmt"}[1d])), sum by (event_type) (bytes_over_time({app="logfmt"}[1d]))) of ({app="logfmt"}[1d])', ["event_type", "__variant__"], "SELECT event_type, v AS __variant__, s AS ts_ms, CASE WHEN v = '0' THEN count(*) ELSE sum(strlen(line)) END::DOUBLE AS value FROM wa, (SELECT unnest(['0', '1']) AS v) GROUP BY event_type, v, s")


def on_logs(name: str, fn: Callable[[DataFrame], DataFrame], sql: str) -> None:
    CASES[f"logql_{name}"] = (lambda spark, sf_dir: fn(signals.logs(spark, sf_dir)), BASE + sql)


on_logs("labels", lambda d: log_analytics.label_values(d), "SELECT 'app' AS name, unnest(['logfmt', 'json']) AS value UNION ALL SELECT DISTINCT 'event_type', event_type FROM ev")
on_logs("series", lambda d: log_analytics.series(d).select(F.col("labels")["app"].alias("app"), F.col("labels")["event_type"].alias("event_type")), "SELECT DISTINCT x.app, event_type FROM ev, (SELECT unnest(['logfmt', 'json']) AS app) x")
on_logs("index_stats", log_analytics.index_stats, "SELECT (SELECT count(DISTINCT event_type) * 2 FROM ev)::BIGINT AS streams, (SELECT count(*) * 2 FROM ev)::BIGINT AS entries, ((SELECT sum(strlen(line)) FROM a) + (SELECT sum(strlen(line)) FROM j))::BIGINT AS bytes")
on_logs("volume", lambda d: log_analytics.volume(d, ["event_type"], DAY), f"SELECT event_type, (ts_ns // 1000000 // {DAY} * {DAY})::BIGINT AS bucket_ms, sum(strlen(line))::BIGINT AS bytes FROM (SELECT * FROM a UNION ALL SELECT * FROM j) GROUP BY ALL")
on_logs("patterns", lambda d: log_analytics.patterns(d.filter("labels['app'] = 'logfmt'"), DAY), f"SELECT format('type={{}} user=<_> value=<_> took=<_> size=<_> msg=\"event <_> done\"', event_type) AS pattern, (ts_ns // 1000000 // {DAY} * {DAY})::BIGINT AS bucket_ms, count(*) AS n FROM a GROUP BY ALL")
on_logs("patterns_json", lambda d: log_analytics.patterns(d.filter("labels['app'] = 'json'"), DAY), f"SELECT format('{{{{\"type\":\"{{}}\",\"user\":\"<_>\",\"value\":\"<_>\",\"nested\":{{{{\"k\":\"<_>\"}}}}}}}}', event_type) AS pattern, (ts_ns // 1000000 // {DAY} * {DAY})::BIGINT AS bucket_ms, count(*) AS n FROM j GROUP BY ALL")
on_logs("detected_fields", lambda d: log_analytics.detected_fields(d.filter("labels['app'] = 'logfmt'")), "SELECT unnest(['type', 'user', 'value', 'took', 'size', 'msg']) AS field, unnest(['string', 'int', 'float', 'duration', 'bytes', 'string']) AS type, unnest([(SELECT count(DISTINCT event_type) FROM ev), (SELECT count(DISTINCT user_id) FROM ev), (SELECT count(DISTINCT val) FROM ev), (SELECT count(DISTINCT took) FROM ev), (SELECT count(DISTINCT size) FROM ev), (SELECT count(DISTINCT event_id) FROM ev)])::BIGINT AS cardinality")


on_logs("detected_labels", log_analytics.detected_labels, "SELECT 'app' AS label, 2::BIGINT AS cardinality UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM ev")
on_logs("detected_values", lambda d: log_analytics.detected_values(d, "type", 3), "SELECT DISTINCT event_type AS value FROM ev ORDER BY value LIMIT 3")


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = signals.logs(spark, sf_dir).filter("labels['app'] = 'logfmt'")
    return log_analytics.without_deleted(d, [('{event_type="click"} |= "user=1 " or "user=2 "', LO, HI)]).select("ts_ns", "line")


CASES["logql_delete_filter"] = (deleted, BASE + L + "NOT (event_type = 'click' AND (contains(line, 'user=1 ') OR contains(line, 'user=2 ')))")
