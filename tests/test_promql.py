"""Time-series queries against plain loops over random series: long windows, extended ranges, label rules, limits, formatting, native histograms."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.operators import storage
from quadrille.plans import promql
from quadrille.plans.lexing import QueryError

SCHEMA = "name string, labels map<string,string>, ts long, v double"
LOOKBACK = 5000


def generated() -> dict[str, list[tuple[int, float]]]:
    """Counters with resets and gaps, one of a single sample."""
    rng = random.Random(11)
    out = {}
    for k in range(6):
        t, v, points = rng.randrange(0, 3000), 0.0, []
        while t < 60_000:
            v = float(rng.randrange(0, 3)) if rng.random() < 0.12 else v + rng.randrange(0, 5)
            points.append((t, v))
            t += rng.choice([400, 900, 1000, 3100, 9000 if k % 2 else 700])
        out[str(k)] = points
    return out | {"single": [(20_000, 4.0)], "exact": [(10_000, 1.0), (20_000, 5.0), (30_000, 2.0), (40_000, 6.0)]}


SERIES = generated()


@pytest.fixture(scope="module")
def store(spark):
    return promql.Store(spark.createDataFrame([("c", {"k": k}, t, v) for k, points in SERIES.items() for t, v in points], SCHEMA).cache())


def got(store, text, start=10_000, end=60_000, step=1000, lookback=LOOKBACK):
    out = defaultdict(dict)
    for r in promql.query_range(store, text, start, end, step, lookback).collect():
        out[r.labels.get("k")][r.ts_ms] = r.value
    return out


FUNCTIONS = ["rate", "increase", "delta", "irate", "idelta", "changes", "resets", *(f"{f}_over_time" for f in ("sum", "avg", "min", "max", "count", "first", "last", "present", "ts_of_first", "ts_of_last"))]


@pytest.mark.parametrize("fn", FUNCTIONS)
def test_long_windows_equal_direct_ones(store, monkeypatch, fn):
    """Windows of 17 to 45 units, from dyadic blocks and by copying each sample to each step."""
    for width, step in (("17s", 1000), ("20s", 3000), ("45s", 1000), ("8s", 1000)):
        long = got(store, f"{fn}(c[{width}])", step=step)
        monkeypatch.setattr(promql, "DYADIC", 1 << 40)
        short = got(store, f"{fn}(c[{width}])", step=step)
        monkeypatch.undo()
        assert long.keys() == short.keys() and all(long[k] == pytest.approx(short[k], nan_ok=True, abs=1e-9) for k in long), (fn, width)


@pytest.mark.parametrize("fn", ["resets", "increase", "avg_over_time", "first_over_time", "last_over_time"])
def test_long_windows_are_shared_by_size(spark, tmp_path, monkeypatch, fn):
    """The tasks of a long window's blocks grow with the bytes of the input, with the same results."""
    rows = [("c", {"k": str(k)}, t * 700 + k, float((t * (k + 3)) % 11)) for k in range(200) for t in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "c"))
    files = promql.Store(spark.read.parquet(str(tmp_path / "c")))
    want = got(files, f"{fn}(c[20s])")
    assert len(want) == 200
    monkeypatch.setattr(promql, "TASK_BYTES", sum(f.stat().st_size for f in (tmp_path / "c").glob("*.parquet")) // 20)
    df = promql.query_range(files, f"{fn}(c[20s])", 10_000, 60_000, 1000, LOOKBACK)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 30
    many = got(files, f"{fn}(c[20s])")
    assert want.keys() == many.keys() and all(want[k] == pytest.approx(many[k], abs=1e-9) for k in want)


def test_long_sums(spark):
    """A window of 1024 units over 4096 steps."""
    aggs = promql.range_function("sum_over_time", 0, [])[0]
    grid = promql.Grid(0, 4_096_000, 1000)
    dense = spark.range(0, 4_096_000, 1000).selectExpr("id + 1 as ts", "1.0D as v", "'x' as name")
    out = promql.over_windows(dense, grid, 1_024_000, ["name"], aggs)
    rows = out.collect()
    assert {r.s: r.x_sum for r in rows} == {s: float(min(s // 1000, 1024)) for s in range(1000, 4_096_001, 1000)}


def extended(points, start, end, kind, smooth):
    """By the samples from the last one at or before the start to, if smoothed, the first one at or after the end."""
    inside = [k for k, (t, _) in enumerate(points) if start < t <= end]
    before = [k for k, (t, _) in enumerate(points) if start - LOOKBACK < t <= start]
    after = [k for k, (t, _) in enumerate(points) if end < t <= end + LOOKBACK]
    chosen = ([before[-1]] if before else []) + inside
    if smooth and after and not (inside and points[inside[-1]][0] == end):
        chosen += [after[0]]
    if not chosen or points[chosen[-1]][0] <= start or (smooth and not inside and not (before and after)):
        return None
    if not smooth and not inside:
        return None
    counter = kind in ("rate", "increase")

    def at(t, k):
        (t0, v0), (t1, v1) = points[k], points[k + 1]
        v0 = 0.0 if counter and v1 < v0 else v0
        return v0 + (v1 - v0) * (t - t0) / (t1 - t0)

    values = [[t, v] for t, v in (points[k] for k in chosen)]
    if smooth and values[0][0] < start:
        values[0] = [start, at(start, chosen[0])]
    if smooth and values[-1][0] > end:
        values[-1] = [end, at(end, chosen[-2] if len(chosen) > 1 else chosen[-1])]
    if kind in ("changes", "resets"):
        return float(sum((b != a if kind == "changes" else b < a) for (_, a), (_, b) in zip(values, values[1:], strict=False)))
    result = values[-1][1] - values[0][1]
    if counter:
        result += sum(a for (_, a), (_, b) in zip(values, values[1:], strict=False) if b < a)
    return result / ((end - start) / 1000) if kind == "rate" else result


@pytest.mark.parametrize(("kind", "how"), [(k, h) for h, ks in (("anchored", ("rate", "increase", "delta", "changes", "resets")), ("smoothed", ("rate", "increase", "delta"))) for k in ks])
def test_extended_ranges(store, kind, how):
    for width in (2000, 7000, 10_000):
        want = {k: {s: x for s in range(10_000, 60_001, 500) if (x := extended(points, s - width, s, kind, how == "smoothed")) is not None} for k, points in SERIES.items()}
        found = got(store, f"{kind}(c[{width}ms] {how})", step=500)
        for k, row in want.items():
            assert found.get(k, {}) == pytest.approx(row, abs=1e-9), (k, width)


def test_extended_ranges_of_other_functions(store):
    for text in ("sum_over_time(c[5s] anchored)", "changes(c[5s] smoothed)"):
        with pytest.raises(QueryError):
            promql.query(store, text, 20_000)


def test_infinite_and_large_numbers(spark):
    values = {"a": math.inf, "b": -math.inf, "c": math.nan, "d": 1e300, "e": 2.5, "f": -2.5, "g": 2.0**60, "h": 1e7, "i": 1.5e-4}
    store = promql.Store(spark.createDataFrame([("m", {"k": k}, 0, v) for k, v in values.items()], SCHEMA))
    for fn, plain in (("round(m)", lambda v: math.floor(v + 0.5)), ("ceil(m)", math.ceil), ("floor(m)", math.floor)):
        rows = {r.labels["k"]: r.value for r in promql.query(store, fn, 0).collect()}
        for k, v in values.items():
            assert rows[k] == pytest.approx(float(plain(v)) if abs(v) < 2**53 else v, nan_ok=True), (fn, k)
    texts = {r.labels["t"] for r in promql.query(store, 'count_values("t", m)', 0).collect()}
    assert {"+Inf", "-Inf", "NaN", "1" + "0" * 300, "2.5", "-2.5", "10000000", "0.00015"} < texts and len(texts) == len(values)


def test_natural_order(spark):
    names = ["a1", "a10", "a2", "b", "", "a2b10", "a2b9", "10", "9", "a-1"]
    store = promql.Store(spark.createDataFrame([("m", {"k": k, "u": str(n)}, 0, 1.0) for n, k in enumerate(names)], SCHEMA))
    want = ["", "9", "10", "a1", "a2", "a2b9", "a2b10", "a10", "a-1", "b"]  # "a" comes before "a-"
    ordered = lambda text: [r.labels.get("k", "") for r in promql.query(store, text, 0).collect()]
    assert ordered('sort_by_label(m, "k")') == want and ordered('sort_by_label_desc(m, "k")') == want[::-1]


def test_info_and_duplicates(spark):
    rows = [("m", {"job": "j", "instance": "i", "a": "1"}, 0, 1.0), ("m", {"job": "j", "instance": "i", "a": "2"}, 0, 1.0), ("target_info", {"job": "j", "instance": "i", "v": "1"}, 0, 1.0)]
    store = promql.Store(spark.createDataFrame(rows, SCHEMA))
    assert {(r.labels["a"], r.labels["v"]) for r in promql.query(store, "info(m)", 0).collect()} == {("1", "1"), ("2", "1")}
    two = promql.Store(spark.createDataFrame([*rows, ("target_info", {"job": "j", "instance": "i", "v": "2"}, 0, 1.0)], SCHEMA))
    with pytest.raises(Exception, match="identifying labels"):
        promql.query(two, "info(m)", 0).collect()
    for text in ('label_replace(m, "a", "x", "a", ".*")', '-{job="j"}'):
        if text[0] == "-":
            clash = promql.Store(spark.createDataFrame([*rows, ("other", {"job": "j", "instance": "i", "a": "1"}, 0, 1.0)], SCHEMA))
        else:
            clash = store
        with pytest.raises(Exception, match="same labelset"):
            promql.query(clash, text, 0).collect()


def test_point_limit(store):
    with pytest.raises(QueryError, match="11000"):
        promql.query_range(store, "c", 0, 11_000, 1)
    promql.query_range(store, "c", 0, 10_999, 1)


TEXTS = {
    "sum   by(a,b)(rate(x{c='d',e!~\"f\"}[5m]))": 'sum by (a, b) (rate(x{c="d", e!~"f"}[5m]))', "a+b*c": "a + b * c", "(a+b)*c": "(a + b) * c", "a-(b-c)": "a - (b - c)", "2^3^2": "2 ^ 3 ^ 2", "(2^3)^2": "(2 ^ 3) ^ 2", "-a^2": "-a ^ 2", "-(a+b)": "-(a + b)",
    "a / on(x) group_left(y) b": "a / on (x) group_left (y) b", "a == bool 1": "a == bool 1", "x offset 90s @ 12.5": "x offset 1m30s @ 12.500", "max_over_time(x[1h:5m] @ end())": "max_over_time(x[1h:5m] @ end())", "topk(3, x)": "topk(3, x)", "quantile without(a)(.5,x)": "quantile without (a) (0.5, x)",
    "{a=~\"b\" or c=\"d\"}": '{a=~"b" or c="d"}', "increase(x[2d] smoothed)": "increase(x[2d] smoothed)", 'label_replace(x, "a", "q\\"z", "b", "c")': 'label_replace(x, "a", "q\\"z", "b", "c")', "a + fill(0) b": "a + fill(0) b", "a unless ignoring(z) b": "a unless ignoring (z) b", "+Inf": "+Inf", "rate(x[5m])[1h:]": "rate(x[5m])[1h:]",
}


def test_formatting():
    for text, want in TEXTS.items():
        node = promql.parse(text)
        assert promql.format_query(node) == want
        assert promql.parse(want) == node, want
        narrow = promql.format_query(node, width=10)
        assert promql.parse(narrow) == node, narrow
    assert promql.format_query(promql.parse("sum by (a) (rate(x[5m])) / sum(rate(y[5m]))"), width=30) == "  sum by (a) (rate(x[5m]))\n/\n  sum(rate(y[5m]))"
    assert promql.tree_of(promql.parse("a + 1")) == {"type": "binary", "op": "+", "left": {"type": "selector", "name": "a", "matchers": [], "range_ms": None, "offset": 0, "at": None, "extend": None}, "right": {"type": "num", "value": 1.0}, "bool_": False, "on": None, "labels": [], "group": None, "include": [], "fill": [None, None]}


HISTOGRAMS = "name string, labels map<string,string>, ts long, schema int, zero_threshold double, zero_count double, count double, sum double, pos map<int,double>, neg map<int,double>, custom array<double>"


def test_native_histograms(spark):
    h = lambda k, t, n, s, pos: ("h", {"k": k}, t, 0, 0.0, 0.0, float(n), float(s), pos, {}, None)
    rows = [h("a", 0, 4, 10, {1: 4.0}), h("a", 60_000, 10, 30, {1: 6.0, 2: 4.0}), h("a", 120_000, 3, 5, {1: 3.0}), h("b", 120_000, 8, 80, {3: 8.0})]
    store = promql.Store(spark.createDataFrame([], SCHEMA), histograms=spark.createDataFrame(rows, HISTOGRAMS))
    value = lambda text, at=120_000: {r.labels.get("k"): r.value for r in promql.query(store, text, at).collect()}
    assert value("histogram_count(h)") == {"a": 3, "b": 8} and value("histogram_sum(h)", 60_000) == {"a": 30} and value("histogram_avg(h)") == {"a": 5 / 3, "b": 10}
    assert value("histogram_count(sum(h))") == {None: 11} and value("histogram_avg(avg(h))") == {None: 85 / 11} and value("histogram_count(avg(h))") == {None: 5.5}
    assert value("histogram_count(h * 3 - h)") == {"a": 6, "b": 16} and value("histogram_sum(-h / 2)") == {"a": -2.5, "b": -40}
    assert value("histogram_quantile(0.5, h)")["b"] == pytest.approx(2**2.5) and value("histogram_fraction(0, 2, h)", 60_000)["a"] == pytest.approx(0.6)
    # 6 more at one minute, a reset to 3 after it: 9 in two of three minutes, from 4 on; the window's edges add half an interval at most
    assert value("histogram_count(increase(h[3m]))")["a"] == pytest.approx(9 * (120 + min(60, 120 * 4 / 9) + 0) / 120)
    assert value("histogram_count(sum_over_time(h[5m]))")["a"] == 17 and value("histogram_count(last_over_time(h[5m]))") == {"a": 3, "b": 8}
    found = {r.labels["k"]: r.histogram.pos for r in promql.query_histograms(store, "h", 60_000, 60_000, 1).collect()}
    assert found == {"a": {1: 6.0, 2: 4.0}}
    assert promql.query(promql.Store(spark.createDataFrame([], SCHEMA)), "histogram_count(h)", 0).collect() == []


def test_election(spark):
    """As a loop over the samples in order."""
    rng = random.Random(8)
    rows, t = [], 0
    for _ in range(300):
        t += rng.choice([1000, 2000, 5000, 40_000])
        rows.append((rng.choice("xy"), rng.choice(["r1", "r2", "r3"]), t))
    want, state = set(), {}
    for c, r, t in rows:
        lead, heard = state.get(c, (None, 0))
        if lead is None or lead == r or t - heard > 30_000:
            state[c] = (r, t)
            want.add((c, t))
    df = spark.createDataFrame([("m", {"cluster": c, "replica": r}, t, 1.0) for c, r, t in rows] + [("m", {"cluster": "x"}, 5, 1.0)], SCHEMA)
    got_ = storage.elect_replicas(df, "cluster", "replica").collect()
    assert {(r.labels["cluster"], r.ts) for r in got_ if r.ts != 5} == want and all("replica" not in r.labels for r in got_) and len(got_) == len(want) + 1


def test_blocks(spark, tmp_path):
    day = storage.DAY_MS
    df = spark.createDataFrame([(t, "m", {"k": str(k)}, d * day + k, float(k)) for t in ("a", "b") for d in range(4) for k in range(50)], "tenant string, name string, labels map<string,string>, ts long, v double")
    path = str(tmp_path / "blocks")
    storage.write_blocks(df, path, "ts", ["name", "ts"])
    got_ = storage.read_blocks(spark, path, "ts", day, 2 * day + 10, ["a"])
    assert sorted(r.ts for r in got_.collect()) == [day + k for k in range(1, 50)] + [2 * day + k for k in range(11)] and {r.tenant for r in got_.collect()} == {"a"}
    plan = got_._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    next((tmp_path / "blocks").glob("tenant=a/day=1/*.parquet")).write_bytes(b"damaged")
    with pytest.raises(Exception):  # noqa: B017
        storage.read_blocks(spark, path, "ts", 0, 4 * day, ["a"]).collect()
    left = storage.read_blocks(spark, path, "ts", -1, 4 * day, ["a"], skip_unreadable=True).collect()
    assert {r.ts // day for r in left} == {0, 2, 3}


def test_shards_and_tenants(spark):
    df = spark.createDataFrame([("m", {"k": str(k), "__tenant_id__": "own"}, 0, 1.0) for k in range(40)], SCHEMA)
    from pyspark.sql import functions as F

    parts = [{r.labels["k"] for r in storage.shard(df, F.col("labels"), n, 3).collect()} for n in range(3)]
    assert sorted(k for p in parts for k in p) == sorted(str(k) for k in range(40)) and all(len(p) > 4 for p in parts)
    both = storage.federated({"t1": df, "t2": df.limit(3)}, "t2|t1|t2")
    assert {(r.labels["__tenant_id__"], r.labels["original___tenant_id__"]) for r in both.collect()} == {("t1", "own"), ("t2", "own")} and both.count() == 43
    assert storage.federated({"t1": df}, "t1").collect() == df.collect()
    with pytest.raises(ValueError, match="t9"):
        storage.federated({"t1": df}, "t1|t9")


def test_start_timestamps(spark):
    """A start after the sample before, or on it where that one had begun earlier, is a reset though the value has not fallen."""
    rows = [("m", {}, 1000, 10.0, 500), ("m", {}, 2000, 12.0, 500), ("m", {}, 3000, 15.0, 2500), ("m", {}, 4000, 20.0, 3000), ("m", {}, 5000, 21.0, 0), ("m", {}, 6000, 22.0, 7000)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, ts long, v double, start_ts long")
    at = lambda text, t=6000: [r.value for r in promql.query(promql.Store(df), text, t).collect()]
    assert at("resets(m[6s])") == [2.0] and at("changes(m[6s])") == [5.0] and at("delta(m[6s])") == [pytest.approx(12 * 6 / 5)]
    plain = [r.value for r in promql.query(promql.Store(df.drop("start_ts")), "increase(m[6s])", 6000).collect()][0]
    assert at("increase(m[6s])")[0] > plain and at("irate(m[2s])", 4000) == [20.0] and at("irate(m[2s])", 5000) == [1.0]
    assert at("start_timestamp(m)", 3500) == [2.5] and at("start_timestamp(m)", 5500) == [0.0] and at("start_timestamp(m + 1)") == []


def test_repair(spark):
    listed = spark.createDataFrame([("a", 1), ("b", 2)], "path string, rows int")
    found = spark.createDataFrame([("b",), ("c",)], "path string")
    assert sorted((r.path, r.rows or 0) for r in storage.repaired(listed, found).collect()) == [("b", 2), ("c", 0)]
