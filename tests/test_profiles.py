from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quadrille.operators import profiles


@pytest.fixture(scope="module")
def samples(spark):
    rows = [
        (1000, {"env": "a"}, ["leaf", "mid", "main"], 5, "cpu"), (1000, {"env": "a"}, ["leaf", "mid", "main"], 2, "cpu"), (1500, {"env": "a"}, ["mid", "main"], 3, "cpu"),
        (2000, {"env": "b"}, ["other_leaf", "mid", "main"], 1, "cpu"), (2500, {"env": "b"}, ["run", "worker"], 4, "cpu"),
    ]
    return spark.createDataFrame(rows, "ts_ms long, labels map<string,string>, stack array<string>, value long, profile_type string")


def test_tree_and_flamegraph(samples):
    nodes = {tuple(r.path): (r["self"], r.total) for r in profiles.tree(profiles.merged(samples)).collect()}
    assert nodes == {("main",): (0, 11), ("main", "mid"): (3, 11), ("main", "mid", "leaf"): (7, 7), ("main", "mid", "other_leaf"): (1, 1), ("worker",): (0, 4), ("worker", "run"): (4, 4)}
    whole = profiles.flamegraph(samples)
    assert whole["total"] == 15 and whole["max_self"] == 7 and whole["levels"][1] == [0, 11, 0, whole["names"].index("main"), 0, 4, 0, whole["names"].index("worker")]
    cut = profiles.flamegraph(samples, 4)
    assert cut["names"] == ["total", "main", "other", "mid", "leaf"] and cut["levels"][1][-4:] == [0, 4, 4, 2] and cut["levels"][3][-4:] == [0, 1, 1, 2]


def test_merge_is_associative(samples):
    left, right = samples.filter("value > 2"), samples.filter("value <= 2")
    parts = profiles.merged(left).unionByName(profiles.merged(right)).groupBy("path").agg(F.sum("value").alias("value"))
    rows = lambda df: sorted((r.path, r["self"], r.total) for r in df.collect())
    assert rows(profiles.tree(parts)) == rows(profiles.tree(profiles.merged(samples)))


def test_diff(samples):
    left, right = (profiles.tree(profiles.merged(samples.filter(F.col("labels")["env"] == e))) for e in "ab")
    rows = {tuple(r.path): (r.total_left, r.total_right) for r in profiles.diff(left, right).collect()}
    assert rows[("main",)] == (10, 1) and rows[("worker",)] == (0, 4)
    flame = profiles.diff_flamegraph(left, right, 3)
    assert (flame["left_ticks"], flame["right_ticks"]) == (10, 5) and "other" in flame["names"] and len(flame["levels"][0]) == 7
    assert flame["levels"][0][:6] == [0, 10, 0, 0, 5, 0]


def test_series_buckets(spark):
    ts = [10, 11, 1011, 1012, 2011, 2012, 3011, 3012, 3511, 3512]
    df = spark.createDataFrame([(t,) for t in ts], "ts long").select("ts", profiles.bucket_end(F.col("ts"), 1011, 3511, 1000).alias("b"))
    assert [r.b for r in df.orderBy("ts").collect()] == [None, 1011, 1011, 2011, 2011, 3011, 3011, None, None, None]


def test_selection_and_series(samples):
    assert profiles.select(samples, '{env="a"}', 0, 5000, call_sites=["main", "mid"]).count() == 3
    assert profiles.select(samples, 'env=~"a|b"', 0, 5000, call_sites=["worker"]).count() == 1
    got = {(tuple(r.labels.items()), r.ts_ms): r.value for r in profiles.series(samples, 1000, 3000, 1000, ["env"], "average").collect()}
    assert got == {((("env", "a"),), 1000): 7.0, ((("env", "a"),), 2000): 3.0, ((("env", "b"),), 2000): 1.0, ((("env", "b"),), 3000): 4.0}


def test_heatmap(samples):
    points = profiles.profile_totals(samples).select("ts_ms", "total")
    got = {(r.time_bucket, r.value_bucket): r.n for r in profiles.heatmap(points, 1000, 3000, 2, 2).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}


def test_empty(spark, samples):
    none = samples.filter("false")
    assert profiles.tree(profiles.merged(none)).count() == 0 and profiles.flamegraph(none)["levels"] == [[0, 0, 0, 0]]


def test_ties_are_bounded(spark):
    """A tree of equal totals: no more nodes come to the driver than a small multiple of those asked for, and totals still add up."""
    rows = [(1000, {"env": "a"}, [f"leaf{k}", "main"], 1, "cpu") for k in range(500)]
    df = spark.createDataFrame(rows, "ts_ms long, labels map<string,string>, stack array<string>, value long, profile_type string")
    nodes = profiles.tree(profiles.merged(df))
    strict = profiles.truncated(nodes, 4, ties=False).collect()
    assert sorted((tuple(r.path), r.total, r.other) for r in strict) == [(("main",), 500, 498), (("main", "leaf0"), 1, 0), (("main", "leaf1"), 1, 0)]
    cut = profiles.flamegraph(df, 4)
    assert cut["total"] == 500 and len(cut["names"]) == 5
    assert len(profiles.flamegraph(df, 100)["names"]) == 502
