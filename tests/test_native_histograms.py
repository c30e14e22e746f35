from __future__ import annotations

import math

import pytest

from quadrille.operators import native_histograms as nh

SCHEMA = "k string, ts long, schema int, zero_threshold double, zero_count double, count double, sum double, pos map<int,double>, neg map<int,double>, custom array<double>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            ("a", 1, 0, 0.001, 2.0, 12.0, 30.0, {1: 4.0, 2: 4.0, 3: 2.0}, {}, None), ("n", 1, 0, 0.0, 0.0, 4.0, -9.0, {}, {1: 2.0, 2: 2.0}, None),
            ("c", 1, -53, 0.0, 0.0, 10.0, 40.0, {0: 4.0, 1: 4.0, 2: 2.0}, {}, [5.0, 10.0]), ("e", 1, 0, 0.0, 0.0, 0.0, 0.0, {}, {}, None),
        ],
        SCHEMA,
    )


def values(df):
    return {r.k: r.v for r in df.collect()}


def test_quantiles(rows):
    got = values(nh.quantile(rows, ["k"], 0.5))
    assert got["a"] == pytest.approx(2.0) and got["n"] == pytest.approx(-2.0) and got["c"] == pytest.approx(6.25) and math.isnan(got["e"])
    got = values(nh.quantile(rows, ["k"], 1.0))
    assert got["a"] == pytest.approx(8.0) and got["n"] == pytest.approx(-1.0) and got["c"] == 10.0
    assert values(nh.quantile(rows, ["k"], 0.25))["a"] == pytest.approx(2**0.25)
    assert values(nh.quantile(rows, ["k"], 2))["a"] == math.inf and values(nh.quantile(rows, ["k"], -1))["a"] == -math.inf


def test_fraction_and_trim(rows):
    got = values(nh.fraction(rows, ["k"], 0, 2))
    assert got["a"] == pytest.approx(0.5) and got["n"] == 0 and got["c"] == pytest.approx(0.16)
    assert values(nh.fraction(rows, ["k"], -math.inf, math.inf))["a"] == 1 and values(nh.fraction(rows, ["k"], 3, 1))["a"] == 0
    kept = {r.k: r["count"] for r in nh.trimmed(rows, ["k"], ">/", 2.0).collect()}
    assert kept["a"] == pytest.approx(6) and kept["e"] == 0


def test_accessors(rows):
    assert values(nh.accessor(rows, ["k"], "avg"))["a"] == 2.5 and math.isnan(values(nh.accessor(rows, ["k"], "avg"))["e"])
    mean, mids = 2.5, [(0.0, 2), (2**0.5, 4), (8**0.5, 4), (32**0.5, 2)]
    want = sum(n * (m - mean) ** 2 for m, n in mids) / 12
    assert values(nh.accessor(rows, ["k"], "stdvar"))["a"] == pytest.approx(want) and values(nh.accessor(rows, ["k"], "stddev"))["a"] == pytest.approx(want**0.5)


def test_merge(spark):
    df = spark.createDataFrame([("x", 1, 1, 0.0, 0.0, 4.0, 5.0, {1: 1.0, 2: 1.0, 3: 2.0}, {}, None), ("x", 2, 0, 0.5, 1.0, 3.0, 7.0, {-1: 1.0, 1: 1.0}, {2: 1.0}, None)], SCHEMA)
    r = nh.merge(df, ["k"]).first()
    assert (r.schema, r.zero_count, r["count"], r["sum"], r.pos, r.neg) == (0, 2.0, 7.0, 12.0, {1: 3.0, 2: 2.0}, {2: 1.0})
    bad = spark.createDataFrame([("x", 1, -53, 0.0, 0.0, 1.0, 1.0, {0: 1.0}, {}, [1.0]), ("x", 2, -53, 0.0, 0.0, 1.0, 1.0, {0: 1.0}, {}, [2.0])], SCHEMA)
    with pytest.raises(Exception, match="custom buckets"):
        nh.merge(bad, ["k"]).collect()


def test_increases(spark):
    h = lambda ts, n, pos: ("x", ts, 0, 0.0, 0.0, n, n, pos, {}, None)
    df = spark.createDataFrame([h(1, 2.0, {1: 2.0}), h(2, 5.0, {1: 3.0, 2: 2.0}), h(3, 6.0, {2: 6.0}), h(4, 1.0, {2: 1.0})], SCHEMA)
    assert [(r.ts, r["count"], r.pos) for r in nh.increases(df, ["k"]).orderBy("ts").collect()] == [(2, 3.0, {1: 1.0, 2: 2.0}), (3, 6.0, {2: 6.0}), (4, 1.0, {2: 1.0})]
