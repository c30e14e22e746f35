"""Registered time-series queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import promql
from .sources import signals

DAY = 86_400_000
START, END, STEP, RANGE = 1704067200000, 1706659200000, DAY, 5 * DAY
#: The windows of five days that end on each day of the grid, with each sample's predecessor inside the window.
BASE = f"""
WITH gauge AS (
  SELECT event_type, user_id::VARCHAR AS user_id, (epoch_us(ts) // 1000)::BIGINT AS ts, arg_max(value, event_id) AS v FROM events GROUP BY ALL),
counter AS (
  SELECT event_type, user_id, ts, sum(v) OVER (PARTITION BY event_type, user_id, ts // {DAY} ORDER BY ts) AS v FROM gauge),
grid AS (SELECT unnest(range({START}, {END} + 1, {STEP}))::BIGINT AS s),
gw AS (SELECT event_type, user_id, s, ts, v, lag(v) OVER w AS pv, lag(ts) OVER w AS pts FROM gauge JOIN grid ON ts > s - {RANGE} AND ts <= s WINDOW w AS (PARTITION BY event_type, user_id, s ORDER BY ts)),
cw AS (SELECT event_type, user_id, s, ts, v, lag(v) OVER w AS pv, lag(ts) OVER w AS pts FROM counter JOIN grid ON ts > s - {RANGE} AND ts <= s WINDOW w AS (PARTITION BY event_type, user_id, s ORDER BY ts)),
inst AS (SELECT event_type, user_id, s, arg_max(v, ts) AS v FROM gauge JOIN grid ON ts > s - {DAY} AND ts <= s GROUP BY ALL)
"""
BOTH = ["event_type", "user_id"]
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def case(name: str, text: str, labels: list[str], sql: str, start: int = START, end: int = END, step: int = STEP, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = promql.query_range(signals.metrics(spark, sf_dir), text, start, end, step, lookback=DAY)
        return df.select(*[F.col("labels")[k].alias(k) for k in labels], "ts_ms", F.round("value", digits).alias("value"))

    CASES[f"promql_{name}"] = (run, BASE + sql)


def windowed(fn: str, expr: str, text: str | None = None, source: str = "gw", where: str = "true") -> None:
    metric = "event_value" if source == "gw" else "event_counter"
    case(fn, text or f"{fn}({metric}[5d])", BOTH, f", x AS (SELECT event_type, user_id, s AS ts_ms, {expr} AS v FROM {source} GROUP BY event_type, user_id, s) SELECT event_type, user_id, ts_ms, round(v, 6)::DOUBLE AS value FROM x WHERE v IS NOT NULL AND {where}")


def extrapolated(kind: str) -> str:
    """The published extrapolation rule over the aggregates of a window."""
    src = "gw" if kind == "delta" else "cw"
    reset = "0" if kind == "delta" else "coalesce(sum(CASE WHEN v < pv THEN pv ELSE 0 END), 0)"
    clamp = "" if kind == "delta" else "WHEN d > 0 AND v0 >= 0 AND sampled * (v0 / d) < g0 THEN sampled * (v0 / d)"
    div = f" / {RANGE / 1000}" if kind == "rate" else ""
    return f""", a AS (SELECT event_type, user_id, s, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(v, ts) AS v0, arg_max(v, ts) - arg_min(v, ts) + {reset} AS d FROM {src} GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT *, (t1 - t0) / 1000.0 AS sampled, (t1 - t0) / 1000.0 / (n - 1) AS av FROM a),
c AS (SELECT *, CASE WHEN (t0 - s + {RANGE}) / 1000.0 >= av * 1.1 THEN av / 2 ELSE (t0 - s + {RANGE}) / 1000.0 END AS g0, CASE WHEN (s - t1) / 1000.0 >= av * 1.1 THEN av / 2 ELSE (s - t1) / 1000.0 END AS g1 FROM b),
e AS (SELECT *, CASE {clamp} WHEN true THEN g0 END AS gs FROM c),
r AS (SELECT event_type, user_id, s, d * ((sampled + gs + g1) / sampled){div} AS v FROM e)
"""


for kind in ("rate", "increase", "delta"):
    metric = "event_value" if kind == "delta" else "event_counter"
    digits = 10 if kind == "rate" else 6
    case(kind, f"{kind}({metric}[5d])", BOTH, extrapolated(kind) + f"SELECT event_type, user_id, s AS ts_ms, round(v, {digits})::DOUBLE AS value FROM r", digits=digits)
case("sum_by_rate", "sum by (event_type) (rate(event_counter[5d]))", ["event_type"], extrapolated("rate") + "SELECT event_type, s AS ts_ms, round(sum(v), 6)::DOUBLE AS value FROM r GROUP BY ALL")
windowed("irate", "CASE WHEN arg_max(pv, ts) IS NOT NULL AND count(*) >= 2 THEN (CASE WHEN arg_max(v, ts) < arg_max(pv, ts) THEN arg_max(v, ts) ELSE arg_max(v, ts) - arg_max(pv, ts) END) / ((max(ts) - arg_max(pts, ts)) / 1000.0) END", source="cw")
windowed("idelta", "CASE WHEN count(*) >= 2 THEN arg_max(v, ts) - arg_max(pv, ts) END")
windowed("changes", "count(*) FILTER (pv IS NOT NULL AND v <> pv)::DOUBLE")
windowed("resets", "count(*) FILTER (pv IS NOT NULL AND v < pv)::DOUBLE", source="cw")
windowed("deriv", "CASE WHEN count(*) >= 2 THEN regr_slope(v, (ts - s) / 1000.0) END", where="isfinite(v)")
windowed("predict_linear", "CASE WHEN count(*) >= 2 THEN regr_intercept(v, (ts - s) / 1000.0) + 3600 * regr_slope(v, (ts - s) / 1000.0) END", "predict_linear(event_value[5d], 3600)")
for fn, expr in {
    "sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "first": "arg_min(v, ts)", "last": "arg_max(v, ts)",
    "present": "1.0", "mad": "mad(v)", "ts_of_first": "min(ts) / 1000.0", "ts_of_last": "max(ts) / 1000.0",
}.items():
    windowed(f"{fn}_over_time", expr)
windowed("quantile_over_time", "quantile_cont(v, 0.9)", "quantile_over_time(0.9, event_value[5d])")
INST = "SELECT event_type, user_id, s AS ts_ms, round({}, 6)::DOUBLE AS value FROM inst WHERE {}"
case("instant_selector", "event_value", BOTH, INST.format("v", "true"))
case("matchers", 'event_value{event_type=~"cl.*|view", user_id!="3", event_type!~"vi.+"}', BOTH, INST.format("v", "event_type IN ('click', 'view') AND user_id <> '3' AND event_type <> 'view'"))
case("or_matchers", 'event_value{event_type="click" or user_id="1"}', BOTH, INST.format("v", "event_type = 'click' OR user_id = '1'"))
for fn, expr in {
    "sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)::DOUBLE", "group": "1.0", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)",
}.items():
    case(f"{fn}_by", f"{fn} by (event_type) (event_value)", ["event_type"], f"SELECT event_type, s AS ts_ms, round({expr}, 6)::DOUBLE AS value FROM inst GROUP BY event_type, s")
case("sum_without", "sum without (user_id) (event_value)", ["event_type"], "SELECT event_type, s AS ts_ms, round(sum(v), 6)::DOUBLE AS value FROM inst GROUP BY event_type, s")
case("quantile_by", "quantile by (event_type) (0.75, event_value)", ["event_type"], "SELECT event_type, s AS ts_ms, round(quantile_cont(v, 0.75), 6)::DOUBLE AS value FROM inst GROUP BY event_type, s")
for fn, order in (("topk", "DESC"), ("bottomk", "ASC")):
    case(f"{fn}_by", f"{fn} by (event_type) (3, event_value)", BOTH, f"SELECT event_type, user_id, s AS ts_ms, round(v, 6)::DOUBLE AS value FROM inst QUALIFY row_number() OVER (PARTITION BY event_type, s ORDER BY v {order}, user_id) <= 3")
case("count_values", 'count_values("n", floor(event_value / 50))', ["n"], "SELECT (floor(v / 50)::BIGINT)::VARCHAR AS n, s AS ts_ms, count(*)::DOUBLE AS value FROM inst GROUP BY ALL")
case("arithmetic", "(event_value * 2 - 10) / 3 % 7 ^ 2", BOTH, INST.format("(v * 2 - 10) / 3 - 49 * trunc((v * 2 - 10) / 3 / 49)", "true"))
case("divide_by_zero", "sum by (event_type) (event_value) / 0 > 0", ["event_type"], "SELECT DISTINCT event_type, s AS ts_ms, 'inf'::DOUBLE AS value FROM inst")
case("compare_filter", "event_value > 100", BOTH, INST.format("v", "v > 100"))
case("compare_bool", "event_value >= bool 100", BOTH, INST.format("CASE WHEN v >= 100 THEN 1 ELSE 0 END", "true"))
SUMS = ", t AS (SELECT event_type, s, sum(v) AS total FROM inst GROUP BY ALL) "
case("ignoring_group_left", "event_value / ignoring (user_id) group_left sum by (event_type) (event_value)", BOTH, SUMS + "SELECT event_type, user_id, s AS ts_ms, round(v / total, 6)::DOUBLE AS value FROM inst JOIN t USING (event_type, s)")
case("on_group_right", "sum by (event_type) (event_value) - on (event_type) group_right event_value", BOTH, SUMS + "SELECT event_type, user_id, s AS ts_ms, round(total - v, 6)::DOUBLE AS value FROM inst JOIN t USING (event_type, s)")
case("one_to_one", "sum by (event_type) (event_value) + count by (event_type) (event_value)", ["event_type"], "SELECT event_type, s AS ts_ms, round(sum(v) + count(*), 6)::DOUBLE AS value FROM inst GROUP BY event_type, s")
case("one_to_one_on", 'sum by (user_id) (event_value{event_type="click"}) - on (user_id) sum by (user_id) (event_value{event_type="view"})', ["user_id"], "SELECT a.user_id, a.s AS ts_ms, round(a.v - b.v, 6)::DOUBLE AS value FROM inst a JOIN inst b ON a.user_id = b.user_id AND a.s = b.s AND a.event_type = 'click' AND b.event_type = 'view'")
case("fill", 'sum by (user_id) (event_value{event_type="click"}) + fill(0) sum by (user_id) (event_value{event_type="view"})', ["user_id"], "SELECT user_id, s AS ts_ms, round(sum(v), 6)::DOUBLE AS value FROM inst WHERE event_type IN ('click', 'view') GROUP BY ALL")
for op, test in (("and", "b.user_id IS NOT NULL"), ("unless", "b.user_id IS NULL")):
    case(op, f'event_value{{event_type="click"}} {op} on (user_id) event_value{{event_type="view"}}', BOTH, f"SELECT a.event_type, a.user_id, a.s AS ts_ms, round(a.v, 6)::DOUBLE AS value FROM inst a LEFT JOIN inst b ON a.user_id = b.user_id AND a.s = b.s AND b.event_type = 'view' WHERE a.event_type = 'click' AND {test}")
case("or", 'event_value{event_type="click"} or on (user_id) event_value{event_type="view"}', BOTH, "SELECT event_type, user_id, s AS ts_ms, round(v, 6)::DOUBLE AS value FROM inst WHERE event_type = 'click' OR (event_type = 'view' AND NOT EXISTS (SELECT 1 FROM inst b WHERE b.event_type = 'click' AND b.user_id = inst.user_id AND b.s = inst.s))")
case("label_replace", 'label_replace(event_value, "kind", "${1}-x", "event_type", "(.).*")', [*BOTH, "kind"], "SELECT event_type, user_id, event_type[1:1] || '-x' AS kind, s AS ts_ms, round(v, 6)::DOUBLE AS value FROM inst")
case("label_join", 'label_join(event_value, "both", "/", "event_type", "user_id")', [*BOTH, "both"], "SELECT event_type, user_id, event_type || '/' || user_id AS both, s AS ts_ms, round(v, 6)::DOUBLE AS value FROM inst")
for fn, expr in {
    "abs": "abs(v - 60)", "ceil": "ceil(v - 60)", "floor": "floor(v - 60)", "sgn": "sign(v - 60)", "exp": "exp((v - 60) / 100)", "ln": "CASE WHEN v > 60 THEN ln(v - 60) WHEN v < 60 THEN 'nan'::DOUBLE ELSE '-inf'::DOUBLE END",
    "sqrt": "CASE WHEN v >= 60 THEN sqrt(v - 60) ELSE 'nan'::DOUBLE END", "sin": "sin(v - 60)", "cos": "cos(v - 60)", "tanh": "tanh(v - 60)", "atan": "atan(v - 60)", "deg": "degrees(v - 60)", "rad": "radians(v - 60)",
}.items():
    case(f"math_{fn}", f"{fn}((event_value - 60){' / 100' if fn == 'exp' else ''})", BOTH, INST.format(expr, "true"))
for fn, expr in {"log2": "log2(v + 1)", "log10": "log10(v + 1)"}.items():
    case(f"math_{fn}", f"{fn}(event_value + 1)", BOTH, INST.format(f"CASE WHEN v > -1 THEN {expr} WHEN v < -1 THEN 'nan'::DOUBLE ELSE '-inf'::DOUBLE END", "true"))
SMALL, DUCK = "tanh((event_value - 60) / 100)", "tanh((v - 60) / 100)"
for fn in ("tan", "asin", "acos", "sinh", "cosh", "asinh", "atanh"):
    case(f"math_{fn}", f"{fn}({SMALL} * 0.9)", BOTH, INST.format(f"{fn}({DUCK} * 0.9)", "true"))
case("math_acosh", f"acosh(cosh({SMALL}))", BOTH, INST.format(f"abs({DUCK})", "true"))
case("round", "round(event_value, 5)", BOTH, INST.format("floor(v * 0.2 + 0.5) / 0.2", "true"))
SIGN = "CASE WHEN v > 0 THEN '{}'::{t} WHEN v < 0 THEN '{}'::{t} ELSE '{}'::{t} END"
case("round_infinite", "round(event_value / 0, 5)", BOTH, INST.format(SIGN.format("inf", "-inf", "nan", t="DOUBLE"), "true"))
case("count_values_infinite", 'count_values("n", event_value / 0)', ["n"], f"SELECT {SIGN.format('+Inf', '-Inf', 'NaN', t='VARCHAR')} AS n, s AS ts_ms, count(*)::DOUBLE AS value FROM inst GROUP BY ALL")
case("limitk", "count by (event_type) (limitk by (event_type) (3, event_value))", ["event_type"], "SELECT event_type, s AS ts_ms, least(3, count(*))::DOUBLE AS value FROM inst GROUP BY event_type, s")
case("limit_ratio", "sum by (event_type) (limit_ratio(0.4, event_value)) + fill(0) sum by (event_type) (limit_ratio(-0.6, event_value))", ["event_type"], "SELECT event_type, s AS ts_ms, round(sum(v), 6)::DOUBLE AS value FROM inst GROUP BY event_type, s")
case("sort_by_label", 'sort_by_label(event_value, "user_id")', BOTH, INST.format("v", "true"))
for end, order in (("min", "ASC"), ("max", "DESC")):
    case(f"ts_of_{end}_over_time", f"ts_of_{end}_over_time(event_value[5d])", BOTH, f"SELECT event_type, user_id, s AS ts_ms, round(ts / 1000.0, 6)::DOUBLE AS value FROM gw QUALIFY row_number() OVER (PARTITION BY event_type, user_id, s ORDER BY v {order}, ts DESC) = 1")
LONG = f", lw AS (SELECT event_type, user_id, s, ts, v, lag(v) OVER w AS pv FROM {{}} JOIN grid ON ts > s - {12 * DAY} AND ts <= s WINDOW w AS (PARTITION BY event_type, user_id, s ORDER BY ts)) "
for fn, expr in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "first": "arg_min(v, ts)", "last": "arg_max(v, ts)"}.items():
    case(f"long_{fn}_over_time", f"{fn}_over_time(event_value[12d])", BOTH, LONG.format("gauge") + f"SELECT event_type, user_id, s AS ts_ms, round({expr}, 6)::DOUBLE AS value FROM lw GROUP BY ALL")
case("long_resets", "resets(event_counter[12d])", BOTH, LONG.format("counter") + "SELECT event_type, user_id, s AS ts_ms, (count(*) FILTER (pv IS NOT NULL AND v < pv))::DOUBLE AS value FROM lw GROUP BY ALL")
case("long_increase", "increase(event_counter[12d])", BOTH, LONG.format("counter") + f""", a AS (SELECT event_type, user_id, s, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(v, ts) AS v0, arg_max(v, ts) - arg_min(v, ts) + coalesce(sum(CASE WHEN v < pv THEN pv ELSE 0 END), 0) AS d FROM lw GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT *, (t1 - t0) / 1000.0 AS sampled, (t1 - t0) / 1000.0 / (n - 1) AS av, (t0 - s + {12 * DAY}) / 1000.0 AS g0, (s - t1) / 1000.0 AS g1 FROM a),
c AS (SELECT *, CASE WHEN g0 >= av * 1.1 THEN av / 2 ELSE g0 END AS e0, CASE WHEN g1 >= av * 1.1 THEN av / 2 ELSE g1 END AS e1 FROM b)
SELECT event_type, user_id, s AS ts_ms, round(d * ((sampled + CASE WHEN d > 0 AND v0 >= 0 AND sampled * (v0 / d) < e0 THEN sampled * (v0 / d) ELSE e0 END + e1) / sampled), 6)::DOUBLE AS value FROM c""")
case("clamp", "clamp(event_value, 20, 80)", BOTH, INST.format("greatest(20, least(80, v))", "true"))
case("clamp_min_max", "clamp_max(clamp_min(event_value, 20), 80)", BOTH, INST.format("greatest(20, least(80, v))", "true"))
for fn, part in {"year": "year", "month": "month", "day_of_month": "day", "day_of_week": "dow", "day_of_year": "doy", "hour": "hour", "minute": "minute"}.items():
    case(f"calendar_{fn}", f"{fn}(timestamp(event_value))", BOTH, f", last_ AS (SELECT event_type, user_id, s, max(ts) AS ts FROM gauge JOIN grid ON ts > s - {DAY} AND ts <= s GROUP BY ALL) SELECT event_type, user_id, s AS ts_ms, date_part('{part}', make_timestamp((ts // 1000) * 1000000))::DOUBLE AS value FROM last_")
case("days_in_month", "days_in_month()", [], "SELECT s AS ts_ms, day(last_day(make_timestamp(s * 1000)))::DOUBLE AS value FROM grid")
case("time", "time() - 1e9 * pi()", [], "SELECT s AS ts_ms, round(s / 1000.0 - 1e9 * pi(), 6)::DOUBLE AS value FROM grid")
case("scalar", 'event_value - scalar(sum(event_value))', BOTH, ", t AS (SELECT s, sum(v) AS total FROM inst GROUP BY ALL) SELECT event_type, user_id, s AS ts_ms, round(v - total, 6)::DOUBLE AS value FROM inst JOIN t USING (s)")
case("absent", 'absent(event_value{user_id="1", event_type="error"})', BOTH, "SELECT 'error' AS event_type, '1' AS user_id, s AS ts_ms, 1.0::DOUBLE AS value FROM grid WHERE NOT EXISTS (SELECT 1 FROM inst WHERE inst.s = grid.s AND user_id = '1' AND event_type = 'error')")
case("absent_over_time", 'absent_over_time(event_value{user_id="none"}[5d])', ["user_id"], "SELECT 'none' AS user_id, s AS ts_ms, 1.0::DOUBLE AS value FROM grid")
case("offset", "event_value offset 2d", BOTH, f"SELECT event_type, user_id, s AS ts_ms, round(arg_max(v, ts), 6)::DOUBLE AS value FROM gauge JOIN grid ON ts > s - {3 * DAY} AND ts <= s - {2 * DAY} GROUP BY ALL")
case("at_modifier", f"sum by (event_type) (event_value @ {(START + DAY) // 1000})", ["event_type"], f", t AS (SELECT event_type, sum(v) AS v FROM inst WHERE s = {START + DAY} GROUP BY ALL) SELECT event_type, s AS ts_ms, round(v, 6)::DOUBLE AS value FROM t, grid")
case("at_end", "sum(sum_over_time(event_value[5d] @ end()))", [], f"SELECT grid.s AS ts_ms, round(t.v, 6)::DOUBLE AS value FROM (SELECT sum(v) AS v FROM gw WHERE s = {END}) t, grid")
case("subquery", "max_over_time(sum by (event_type) (event_value)[3d:1d])", ["event_type"], f", fine AS (SELECT unnest(range({START - 3 * DAY}, {END} + 1, {DAY}))::BIGINT AS f), t AS (SELECT event_type, f, sum(v) AS v FROM (SELECT event_type, user_id, f, arg_max(v, ts) AS v FROM gauge JOIN fine ON ts > f - {DAY} AND ts <= f GROUP BY ALL) GROUP BY ALL) SELECT event_type, s AS ts_ms, round(max(v), 6)::DOUBLE AS value FROM t JOIN grid ON f > s - {3 * DAY} AND f <= s GROUP BY ALL")
HIST = """, h AS (SELECT l_returnflag AS flag, b AS le, count(*) FILTER (l_quantity <= b)::DOUBLE AS c FROM lineitem, (SELECT unnest([10.0, 20.0, 30.0, 40.0, 50.0, 'inf'::DOUBLE])::DOUBLE AS b) GROUP BY ALL),
p AS (SELECT *, coalesce(lag(c) OVER w, 0) AS pc, coalesce(lag(le) OVER w, 0) AS pl, max(c) OVER (PARTITION BY flag) AS total FROM h WINDOW w AS (PARTITION BY flag ORDER BY le)) """
AT = 1705276800000
case("histogram_quantile", "histogram_quantile(0.7, quantity_bucket)", ["flag"], HIST + f"SELECT flag, {AT}::BIGINT AS ts_ms, round(pl + (le - pl) * (0.7 * total - pc) / (c - pc), 6)::DOUBLE AS value FROM p WHERE c >= 0.7 * total QUALIFY row_number() OVER (PARTITION BY flag ORDER BY le) = 1", AT, AT, 1)
case("histogram_quantiles", 'histogram_quantiles("q", quantity_bucket, 0.25, 0.7)', ["flag", "q"], HIST + f"SELECT flag, q::VARCHAR AS q, {AT}::BIGINT AS ts_ms, round(pl + (le - pl) * (q * total - pc) / (c - pc), 6)::DOUBLE AS value FROM p, (SELECT unnest([0.25, 0.7])::DOUBLE AS q) WHERE c >= q * total QUALIFY row_number() OVER (PARTITION BY flag, q ORDER BY le) = 1", AT, AT, 1)
case("histogram_fraction", "histogram_fraction(5, 25, quantity_bucket)", ["flag"], HIST + f"SELECT flag, {AT}::BIGINT AS ts_ms, round(sum(CASE WHEN le = 10 THEN (c - pc) * 0.5 WHEN le = 20 THEN c - pc WHEN le = 30 THEN (c - pc) * 0.5 ELSE 0 END) / max(total), 6)::DOUBLE AS value FROM p GROUP BY flag", AT, AT, 1)


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = promql.query(signals.metrics(spark, sf_dir), "info(event_value, {__name__=\"user_info\"})", AT, DAY, info_by=("user_id",))
    return df.select(*[F.col("labels")[k].alias(k) for k in (*BOTH, "tier")], "ts_ms", F.round("value", 6).alias("value"))


CASES["promql_info"] = (info, BASE + f"SELECT event_type, user_id, CASE WHEN user_id::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS tier, s AS ts_ms, round(v, 6)::DOUBLE AS value FROM inst WHERE s = {AT}")
case("sort", "sort_desc(sum by (event_type) (event_value))", ["event_type"], "SELECT event_type, s AS ts_ms, round(sum(v), 6)::DOUBLE AS value FROM inst GROUP BY event_type, s")
case("holt", "double_exponential_smoothing(event_value[5d], 0.3, 0.6)", BOTH, f""", n AS (SELECT event_type, user_id, s, list(v ORDER BY ts) AS w FROM gw GROUP BY ALL HAVING count(*) >= 2)
SELECT event_type, user_id, s AS ts_ms, round(list_reduce(list_prepend({{'s1': w[1], 'b': w[2] - w[1]}}, list_transform(w[2:], lambda v: {{'s1': v, 'b': 0.0}})),
  lambda a, e: {{'s1': 0.3 * e.s1 + 0.7 * (a.s1 + a.b), 'b': 0.6 * (0.3 * e.s1 + 0.7 * (a.s1 + a.b) - a.s1) + 0.4 * a.b}}).s1, 6)::DOUBLE AS value FROM n""")
ANCHOR = f", an AS (SELECT event_type, user_id, s, arg_max(v, ts) AS a FROM {{}} JOIN grid ON ts > s - {RANGE} - {DAY} AND ts <= s - {RANGE} GROUP BY ALL) "
case("anchored_delta", "delta(event_value[5d] anchored)", BOTH, ANCHOR.format("gauge") + "SELECT event_type, user_id, s AS ts_ms, round(arg_max(v, ts) - coalesce(any_value(a), arg_min(v, ts)), 6)::DOUBLE AS value FROM gw LEFT JOIN an USING (event_type, user_id, s) GROUP BY ALL")
case("anchored_increase", "increase(event_counter[5d] anchored)", BOTH, ANCHOR.format("counter") + """, f AS (SELECT event_type, user_id, s, arg_min(v, ts) AS v0, arg_max(v, ts) AS v1, coalesce(sum(CASE WHEN v < pv THEN pv END), 0) AS fell FROM cw GROUP BY ALL)
SELECT event_type, user_id, s AS ts_ms, round(v1 - coalesce(a, v0) + fell + CASE WHEN v0 < a THEN a ELSE 0 END, 6)::DOUBLE AS value FROM f LEFT JOIN an USING (event_type, user_id, s)""")
case("anchored_changes", "changes(event_value[5d] anchored)", BOTH, ANCHOR.format("gauge") + "SELECT event_type, user_id, s AS ts_ms, (count(*) FILTER (v <> coalesce(pv, a, v)))::DOUBLE AS value FROM gw LEFT JOIN an USING (event_type, user_id, s) GROUP BY ALL")


def federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import storage

    samples = signals.metrics(spark, sf_dir).samples.filter("name = 'event_value'")
    parity = F.col("labels")["user_id"].cast("long") % 2
    tables = {"even": samples.filter(parity == 0), "odd": samples.filter(parity == 1), "none": samples.filter("false")}
    df = promql.query_range(promql.Store(storage.federated(tables, "even|odd")), "sum by (__tenant_id__) (count_over_time(event_value[5d]))", START, END, STEP)
    return df.select(F.col("labels")["__tenant_id__"].alias("tenant"), "ts_ms", "value")


CASES["promql_federation"] = (federation, BASE + "SELECT CASE WHEN user_id::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS tenant, s AS ts_ms, count(*)::DOUBLE AS value FROM gw GROUP BY ALL")


def started(name: str, text: str, sql: str) -> None:
    """On counters that say since when they count: the first ms of the day; every third user's counts grow on over the days, and only that tells their resets."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grown = F.when(F.col("labels")["user_id"].cast("long") % 3 == 0, F.expr(f"ts div {DAY}") * 1_000_000.0).otherwise(F.lit(0.0))
        samples = signals.metrics(spark, sf_dir).samples.filter("name = 'event_counter'").withColumn("v", F.col("v") + grown).withColumn("start_ts", F.expr(f"ts div {DAY} * {DAY}"))
        df = promql.query_range(promql.Store(samples), text, START, END, STEP, lookback=DAY)
        return df.select(*[F.col("labels")[k].alias(k) for k in BOTH], "ts_ms", F.round("value", 6).alias("value"))

    CASES[f"promql_{name}"] = (run, BASE + sql)


started("start_timestamp", "start_timestamp(event_counter)", f"SELECT event_type, user_id, s AS ts_ms, (max(ts) // {DAY} * {DAY // 1000})::DOUBLE AS value FROM counter JOIN grid ON ts > s - {DAY} AND ts <= s GROUP BY ALL")
started("start_resets", "resets(event_counter[5d])", f"SELECT event_type, user_id, s AS ts_ms, (count(*) FILTER (pv IS NOT NULL AND (ts // {DAY} <> pts // {DAY} AND ts % {DAY} <> 0 OR user_id::BIGINT % 3 <> 0 AND v < pv)))::DOUBLE AS value FROM cw GROUP BY ALL")
#: What native histograms hold: of each step, the events up to its day (h), those of the five days before it (w), in buckets of powers of two.
NATIVE = f""", d AS (SELECT event_type, ((epoch_us(ts) // 1000) // {DAY} + 1) * {DAY} AS day, ceil(log2(value))::INT AS i, value FROM events WHERE value > 0),
days AS (SELECT DISTINCT event_type, day FROM d),
h AS (SELECT d.event_type, s, i, value FROM d JOIN grid ON day <= s JOIN days last ON last.event_type = d.event_type AND last.day > s - {DAY} AND last.day <= s),
hb AS (SELECT event_type, s, i, count(*) AS n FROM h GROUP BY ALL),
hc AS (SELECT *, sum(n) OVER (PARTITION BY event_type, s ORDER BY i) AS upto, sum(n) OVER (PARTITION BY event_type, s) AS total FROM hb) """
case("native_count", "histogram_count(event_size)", ["event_type"], NATIVE + "SELECT event_type, s AS ts_ms, count(*)::DOUBLE AS value FROM h GROUP BY ALL")
case("native_sum", "histogram_sum(event_size)", ["event_type"], NATIVE + "SELECT event_type, s AS ts_ms, round(sum(value), 6)::DOUBLE AS value FROM h GROUP BY ALL")
case("native_avg", "histogram_avg(sum(event_size))", [], NATIVE + "SELECT s AS ts_ms, round(avg(value), 6)::DOUBLE AS value FROM h GROUP BY ALL")
case("native_stdvar", "histogram_stdvar(event_size)", ["event_type"], NATIVE + ", m AS (SELECT event_type, s, avg(value) AS mean FROM h GROUP BY ALL) SELECT event_type, s AS ts_ms, round(sum(n * (pow(2, i - 0.5) - mean) * (pow(2, i - 0.5) - mean)) / sum(n), 6)::DOUBLE AS value FROM hb JOIN m USING (event_type, s) GROUP BY ALL")
case("native_stddev", "histogram_stddev(2 * event_size)", ["event_type"], NATIVE + ", m AS (SELECT event_type, s, avg(value) AS mean FROM h GROUP BY ALL) SELECT event_type, s AS ts_ms, round(sqrt(sum(n * (pow(2, i - 0.5) - mean) * (pow(2, i - 0.5) - mean)) / sum(n)), 6)::DOUBLE AS value FROM hb JOIN m USING (event_type, s) GROUP BY ALL")
case("native_quantile", "histogram_quantile(0.7, event_size)", ["event_type"], NATIVE + "SELECT event_type, s AS ts_ms, round(pow(2, i - 1 + (0.7 * total - upto + n) / n), 6)::DOUBLE AS value FROM hc WHERE upto >= 0.7 * total AND upto - n < 0.7 * total")
case("native_fraction", "histogram_fraction(0, 48, event_size)", ["event_type"], NATIVE + "SELECT event_type, s AS ts_ms, round(sum(CASE WHEN i <= 5 THEN n WHEN i = 6 THEN n * (log2(48) - 5) ELSE 0 END) / max(total), 6)::DOUBLE AS value FROM hc GROUP BY ALL")
case("native_arithmetic", "histogram_count(event_size / 2 + event_size * 3 - event_size)", ["event_type"], NATIVE + "SELECT event_type, s AS ts_ms, round(count(*) * 2.5, 6)::DOUBLE AS value FROM h GROUP BY ALL")
case("native_increase", "histogram_count(increase(event_size[5d]))", ["event_type"], NATIVE + f""", p AS (SELECT event_type, day, count(*) AS n FROM d GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY day) AS total FROM p),
w AS (SELECT event_type, s, count(*) AS k, min(day) AS t0, max(day) AS t1, arg_min(total, day) AS c0, arg_max(total, day) - arg_min(total, day) AS d FROM c JOIN grid ON day > s - {RANGE} AND day <= s GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT *, (t1 - t0) / 1000.0 AS sampled, (t1 - t0) / 1000.0 / (k - 1) AS av, (t0 - s + {RANGE}) / 1000.0 AS g0, (s - t1) / 1000.0 AS g1 FROM w),
e AS (SELECT *, CASE WHEN g0 >= av * 1.1 THEN av / 2 ELSE g0 END AS e0, CASE WHEN g1 >= av * 1.1 THEN av / 2 ELSE g1 END AS e1 FROM b)
SELECT event_type, s AS ts_ms, round(d * (sampled + CASE WHEN d > 0 AND sampled * c0 / d < e0 THEN sampled * c0 / d ELSE e0 END + e1) / sampled, 6)::DOUBLE AS value FROM e""")
case("native_rate_avg", "histogram_avg(sum by (event_type) (rate(event_size[5d])))", ["event_type"], NATIVE + f""", w AS (SELECT event_type, s, min(day) AS t0 FROM days JOIN grid ON day > s - {RANGE} AND day <= s GROUP BY ALL HAVING count(*) >= 2)
SELECT d.event_type, s AS ts_ms, round(avg(value), 6)::DOUBLE AS value FROM w JOIN d ON d.event_type = w.event_type AND day > t0 AND day <= s GROUP BY ALL""")
