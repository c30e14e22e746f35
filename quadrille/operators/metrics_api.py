"""Metadata, cardinality, exemplars and search over metric samples (name, labels, ts, v)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import labels_of, matches
from ..plans.lexing import QueryError
from ..plans.promql import Selector, parse


def matching(df: DataFrame, text: str) -> DataFrame:
    """Rows (name, labels, …) that a selector matches."""
    node = parse(text)
    if not isinstance(node, Selector):
        raise QueryError("a selector is expected")
    test = F.col("name") == node.name if node.name else F.lit(True)
    groups = [g for g in node.matchers if g]
    value = lambda k: F.col("name") if k == "__name__" else F.col("labels")[k]
    if groups:
        some = F.lit(False)
        for g in groups:
            one = F.lit(True)
            for k, op, v in g:
                one &= matches(value(k), op, v)
            some = some | one
        test &= some
    return df.filter(test)


def series(samples: DataFrame, text: str) -> DataFrame:
    """(name, labels) of the series that match."""
    return matching(samples, text).select("name", labels_of(F.col("labels")).alias("ls")).distinct().select("name", F.map_from_entries("ls").alias("labels"))


def label_names(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode(F.concat(F.array(F.lit("__name__")), F.map_keys("labels"))).alias("name")).distinct()


def label_values(samples: DataFrame, name: str) -> DataFrame:
    value = F.col("name") if name == "__name__" else F.col("labels")[name]
    return samples.select(value.alias("value")).filter("value is not null and value <> ''").distinct()


def _series(samples: DataFrame) -> DataFrame:
    return samples.select("name", labels_of(F.col("labels")).alias("ls")).distinct()


def label_cardinality(samples: DataFrame) -> DataFrame:
    """(label, values, series): how many values and series each label has.  Series are counted once, before labels are taken apart."""
    pairs = _series(samples).select(F.explode("ls").alias("e"))
    per_value = pairs.groupBy("e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy(F.col("k").alias("label")).agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("series"))


def value_cardinality(samples: DataFrame, name: str) -> DataFrame:
    """(value, series) of one label."""
    value = F.col("name") if name == "__name__" else F.get(F.filter("ls", lambda e: e["k"] == name), 0)["v"]
    return _series(samples).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("series")).filter("value is not null")


def active_series(samples: DataFrame, text: str, now_ms: int, window_ms: int) -> DataFrame:
    """(name, series): series that match and have a sample in the window."""
    recent = matching(samples.filter((F.col("ts") > now_ms - window_ms) & (F.col("ts") <= now_ms)), text)
    return _series(recent).groupBy("name").agg(F.count(F.lit(1)).alias("series"))


def head_stats(samples: DataFrame) -> DataFrame:
    """(series, samples, min_ts, max_ts)."""
    by = samples.groupBy("name", labels_of(F.col("labels")).alias("ls")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return by.agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("samples"), F.min("a").alias("min_ts"), F.max("b").alias("max_ts"))


def exemplars(rows: DataFrame, text: str, start_ms: int, end_ms: int) -> DataFrame:
    """Exemplars (name, labels, ts, v, trace_id, span_id) of the series of a selector in the closed range."""
    return matching(rows.filter(F.col("ts").between(start_ms, end_ms)), text)


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two words: matches within half the longer length, transpositions, and a bonus for up to four equal first letters."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def subsequence(value: Column, wanted: str) -> Column:
    """Whether the letters of ``wanted`` stand in ``value`` in order."""
    return F.lower(value).rlike(".*?".join("\\Q" + c + "\\E" for c in wanted.lower()))


def search_names(names: DataFrame, wanted: str, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """(name, score): names that hold the words, or are like them, best first.  ``names`` has distinct names."""

    @F.pandas_udf("double")
    def alike(x: pd.Series) -> pd.Series:
        return x.map(lambda v: jaro_winkler(v.lower(), wanted.lower()))

    name = F.col("name")
    held = F.lower(name).contains(wanted.lower())
    if not fuzzy:
        return names.filter(held).select("name", F.lit(1.0).alias("score")).orderBy("name").limit(limit)
    score = F.when(held, 1.0).otherwise(alike(name))
    return names.withColumn("score", score).filter(held | subsequence(name, wanted) | (F.col("score") >= 0.8)).orderBy(F.desc("score"), "name").limit(limit).select("name", "score")
