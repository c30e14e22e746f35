"""Signal tables at rest: sorted writing, compaction with duplicate collapse, retention, erasure, tombstones and audit.

Tables are Parquet folders partitioned by tenant and day, each file sorted by series and time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import labels_of

DAY_MS = 86_400_000


def series_key(labels: Column) -> Column:
    """A hash of the label set; equal whatever the order of the map."""
    return F.xxhash64(labels_of(labels))


def write_blocks(df: DataFrame, path: str, time: str, sort: list[str], per_day: int | None = None, mode: str = "append", day_units: int = DAY_MS, bloom: list[str] = ()) -> None:
    """Write rows by tenant and day, sorted; blooms speed up point lookups of ids.

    Adaptive execution makes as many tasks and files of a day as its size asks for (spark.sql.adaptive.advisoryPartitionSizeInBytes), and
    joins small days in one task; ``per_day`` fixes the number of files instead.
    """
    by = ["tenant", "day"] if "tenant" in df.columns else ["day"]
    dated = df.withColumn("day", F.call_function("div", F.col(time), F.lit(day_units)))
    dealt = dated.hint("rebalance", *by) if per_day is None else dated.repartition(*by, F.pmod(F.xxhash64(*sort[:1]), F.lit(per_day)))
    out = dealt.sortWithinPartitions(*by, *sort).write.mode(mode).partitionBy(*by)
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def read_blocks(spark: SparkSession, path: str, time: str, low: int, high: int, tenants: list[str] | None = None, day_units: int = DAY_MS, skip_unreadable: bool = False) -> DataFrame:
    """Rows with low < time <= high of written blocks: only their tenants' and days' folders are listed and read.

    ``skip_unreadable`` leaves out files that are damaged or gone, instead of failing.
    """
    source = spark.read.option("ignoreCorruptFiles", skip_unreadable).option("ignoreMissingFiles", skip_unreadable)
    df = source.parquet(path)
    test = F.col("day").between(low // day_units, high // day_units) & (F.col(time) > low) & (F.col(time) <= high)
    if tenants is not None:
        test &= F.col("tenant").isin(tenants)
    return df.filter(test).drop("day")


def shard(df: DataFrame, labels: Column, number: int, of: int) -> DataFrame:
    """Rows of the series of one of ``of`` shards; a series is in the same shard wherever it is stored.

    The shard is the beginning of the md5 of the sorted labels, so that other systems can tell it too.
    """
    if not 0 <= number < of:
        raise ValueError(f"no shard {number} of {of}")
    text = F.array_join(F.transform(labels_of(labels), lambda e: F.concat(e["k"], F.lit("\x1e"), e["v"])), "\x1f")
    return df.filter(F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(of)) == number)


TENANT = "__tenant_id__"


def federated(tables: dict[str, DataFrame], tenants: str, labels: str = "labels") -> DataFrame:
    """The rows of the tenants ``a|b|c`` as one table; each series carries its tenant as a label, a label of that name becomes original_…

    Sums and ranks over tenants are worked out after the union, so that none of them loses what another tenant adds.
    """
    wanted = sorted(dict.fromkeys(t.strip() for t in tenants.split("|")))
    if missing := [t for t in wanted if t not in tables]:
        raise ValueError(f"no tenants {missing}")
    out = None
    for t in wanted:
        df = tables[t]
        if len(wanted) > 1:
            own = F.transform_keys(labels, lambda k, v: F.when(k == TENANT, F.lit(f"original_{TENANT}")).otherwise(k))
            df = df.withColumn(labels, F.map_concat(own, F.create_map(F.lit(TENANT), F.lit(t))))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def collapse(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in ``order``.  A minimum by key, which sums before it shuffles."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(ranked).select(*key, "_r.*").select(*df.columns)


def merge_hot_and_cold(cold: DataFrame, hot: DataFrame, key: list[str]) -> DataFrame:
    """Blocks and recent data as one table; where both hold a key, the block's row stays."""
    both = cold.withColumn("_hot", F.lit(0)).unionByName(hot.withColumn("_hot", F.lit(1)), allowMissingColumns=True)
    return collapse(both, key, ["_hot"]).drop("_hot")


def hot_beyond_cold(cold: DataFrame, hot: DataFrame, cold_ids: str, hot_id: str) -> DataFrame:
    """All of the blocks and those hot rows whose log ids no block lists."""
    known = cold.select(F.explode(cold_ids).alias(hot_id)).distinct()
    return cold.unionByName(hot.join(known, hot_id, "left_anti"), allowMissingColumns=True)


def compact(spark: SparkSession, source: str, target: str, time: str, sort: list[str], key: list[str], first: str, per_day: int | None = None) -> None:
    """Rewrite a table's files as fewer sorted ones; of rows with equal keys that with the smallest ``first`` stays."""
    df = collapse(spark.read.parquet(source).drop("day"), key, [first])
    write_blocks(df, target, time, sort, per_day, "overwrite")


def expired(df: DataFrame, time: str, now: int, keep_for: int) -> Column:
    return (F.col(time) < now - keep_for) if keep_for > 0 else F.lit(False)


def retain(df: DataFrame, time: str, now: int, keep_for: int, tenants: dict[str, int] | None = None) -> DataFrame:
    """Rows that are young enough; 0 keeps for ever, ``tenants`` sets other periods."""
    test = expired(df, time, now, keep_for)
    for tenant, period in (tenants or {}).items():
        test = F.when(F.col("tenant") == tenant, expired(df, time, now, period)).otherwise(test)
    return df.filter(~test)


def erase(df: DataFrame, requests: list[tuple[Column, int, int]], time: str) -> DataFrame:
    """Rows that no erasure request (condition, from, to) covers."""
    gone = F.lit(False)
    for test, low, high in requests:
        gone = gone | (test & F.col(time).between(low, high))
    return df.filter(~F.coalesce(gone, F.lit(False)))


def without_tombstones(samples: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Samples (labels, ts) that no tombstone (series hash, low, high) covers."""
    spans = tombstones.groupBy("series").agg(F.collect_list(F.struct("low", "high")).alias("_gone"))
    joined = samples.withColumn("series", series_key(F.col("labels"))).join(spans, "series", "left")
    hit = F.exists("_gone", lambda g: F.col("ts").between(g["low"], g["high"]))
    return joined.filter(~F.coalesce(hit, F.lit(False))).drop("series", "_gone")


def audit(listed: DataFrame, found: DataFrame, by: str = "path") -> DataFrame:
    """(path, state): blocks that the index lists and storage lacks, and the other way round."""
    return listed.select(by, F.lit("missing").alias("state")).join(found, by, "left_anti").unionByName(found.select(by, F.lit("unlisted").alias("state")).join(listed, by, "left_anti"))


def repaired(listed: DataFrame, found: DataFrame, by: str = "path") -> DataFrame:
    """The index as it should be: entries whose blocks are there, and entries of blocks that it lacks, with what is known of them."""
    return listed.join(found.select(by), by, "left_semi").unionByName(found.join(listed.select(by), by, "left_anti"), allowMissingColumns=True)


def latest_per_series(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name", labels_of(F.col("labels")).alias("ls")).agg(F.max_by("v", "ts").alias("v"), F.max("ts").alias("ts"))


def _elected(batches: Iterator[pa.RecordBatch], timeout: int) -> Iterator[pa.RecordBatch]:
    """Of rows (cluster, replica, time, …), sorted by cluster, time and replica, those of the replica that is elected then."""
    cluster, lead, heard = None, None, 0
    for batch in batches:
        keep = []
        for c, r, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if c != cluster:
                cluster, lead = c, None
            if lead is None or r == lead or t - heard > timeout:
                lead, heard = r, t
                keep.append(True)
            else:
                keep.append(False)
        if any(keep):
            yield batch.filter(pa.array(keep))


def elect_replicas(samples: DataFrame, cluster: str, replica: str, timeout_ms: int = 30_000) -> DataFrame:
    """Of each cluster's replicas one is heard at a time: the elected one, until it has been silent for more than ``timeout_ms`` and another speaks.

    The first to speak is elected; of several at one time, the first by name.  Only the times at which replicas speak go through
    Python, streamed in order; what the elected ones say is joined with them.  Samples without both labels stay.
    """
    keyed = samples.withColumns({"_c": F.col("labels")[cluster], "_r": F.col("labels")[replica]})
    heard = keyed.filter("_c is not null and _r is not null").select("_c", "_r", "ts").distinct()
    kept = heard.repartition("_c").sortWithinPartitions("_c", "ts", "_r").mapInArrow(lambda it: _elected(it, timeout_ms), "_c string, _r string, ts long")
    alone = keyed.filter("_c is null or _r is null").select(samples.columns)
    own = keyed.join(kept, ["_c", "_r", "ts"]).withColumn("labels", F.map_filter("labels", lambda k, v: k != replica))
    return own.select(samples.columns).unionByName(alone)
