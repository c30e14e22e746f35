"""Time-series and log queries: unit vectors, errors, and registered queries against DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quadrille import catalog
from quadrille.plans import logql, promql
from quadrille.plans.lexing import QueryError

SF = "/root/testdata/sf0.001"
SERIES = {
    "climb": [(0, 0), (60_000, 1), (120_000, 2), (180_000, 3), (240_000, 4)], "reset": [(0, 1), (60_000, 2), (120_000, 1)], "gauge": [(30_000, 4), (60_000, 3)],
    "uneven": [(0, 0), (60_000, 1), (90_000, 3)], "fall": [(0, 5), (1000, 2)],
}


@pytest.fixture(scope="module")
def store(spark):
    rows = [(name, {}, t, float(v), False) for name, points in SERIES.items() for t, v in points] + [("stale", {}, 0, 1.0, False), ("stale", {}, 60_000, math.nan, True), ("twin", {"a": "1", "b": "x"}, 0, 1.0, False), ("twin", {"a": "1", "b": "y"}, 0, 2.0, False)]
    return promql.Store(spark.createDataFrame(rows, "name string, labels map<string,string>, ts long, v double, is_stale boolean").cache())


@pytest.mark.parametrize(
    ("text", "at", "want"),
    [
        ("rate(climb[5m])", 300_000, [5 / 300]), ("increase(reset[2m])", 120_000, [2.0]), ("delta(gauge[1m])", 60_000, [-2.0]), ("irate(uneven[5m])", 90_000, [2 / 30]), ("idelta(uneven[5m])", 90_000, [2.0]), ("irate(fall[5m])", 1000, [2.0]),
        ("idelta(fall[5m])", 1000, [-3.0]), ("stale", 30_000, [1.0]), ("stale", 90_000, []), ("climb", 240_000 + 299_999, [4.0]), ("climb", 240_000 + 300_000, []), ("climb offset 1m", 240_000, [3.0]), ("climb @ 60", 240_000, [1.0]),
        ("1 / 0", 0, [math.inf]), ("-1 % 0", 0, [math.nan]), ("2 ^ 3 ^ 2", 0, [512.0]), ("-2 ^ 2", 0, [-4.0]), ("resets(reset[5m])", 120_000, [1.0]), ("changes(climb[5m])", 240_000, [4.0]), ("sum(twin)", 0, [3.0]),
        ("max_over_time(climb[2m:1m])", 240_000, [4.0]), ("count(twin) by (a) > bool 1", 0, [1.0]), ("scalar(twin)", 0, [math.nan]), ("absent(nothing)", 0, [1.0]), ("quantile(0.5, twin)", 0, [1.5]), ("climb[5m*2]", 0, QueryError), ("sum(", 0, QueryError), ("{a=~\".*\"}", 0, QueryError),
    ],
)
def test_values(store, text, at, want):
    if want is QueryError:
        with pytest.raises(QueryError):
            promql.query(store, text, at)
        return
    got = [r.value for r in promql.query(store, text, at).collect()]
    assert got == pytest.approx(want, nan_ok=True)


def test_duplicate_matches_fail(store):
    with pytest.raises(Exception, match="duplicate series"):
        promql.query(store, "twin + on (a) twin", 0).collect()


def test_log_errors(spark):
    logs = spark.createDataFrame([({"app": "x"}, 10**9, "v=1", {}), ({"app": "x"}, 2 * 10**9, "v=bad", {})], "labels map<string,string>, ts_ns long, line string, metadata map<string,string>")
    with pytest.raises(Exception, match="pipeline error"):
        logql.query_metrics(logs, 'sum_over_time({app="x"} | logfmt | unwrap v [1m])', 0, 60_000, 60_000).collect()
    rows = logql.query_metrics(logs, 'sum_over_time({app="x"} | logfmt | unwrap v | __error__="" [1m])', 0, 60_000, 60_000).collect()
    assert [r.value for r in rows] == [1.0]
    for bad in ("{}", '{app="x"} | nothing', '{app="x"} |= '):
        with pytest.raises(QueryError):
            logql.parse(bad)


CHOSEN = ["promql_sum_by_rate", "promql_fill", "promql_subquery", "promql_histogram_quantile", "logql_logfmt_parser", "logql_label_format", "logql_variants", "logql_detected_fields", "traceql_union_child", "traceql_compare", "profile_truncated", "profile_heatmap", "stream_alerting_rule", "storage_tombstones", "metrics_label_cardinality"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in got.description]
    clean = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v)
    want = sorted(repr([clean(v) for v in r]) for r in got.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr([clean(r[c]) for c in columns]) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
