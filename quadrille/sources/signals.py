"""The four signals, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tasks import dealt, tasks_for
from ..plans.logql import LogTable
from ..plans.promql import Store


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


MILLIS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000"


def millis(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) div 1000")


def within(df: DataFrame, column: str, low_us: int, high_us: int) -> DataFrame:
    """Rows whose timestamp is in the range, both ends included: a comparison of the column itself, which reaches the files."""
    at = lambda us: F.expr(f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    bound = at if df.schema[column].dataType.simpleString() == "timestamp_ntz" else lambda us: F.timestamp_micros(F.lit(us))
    return df.filter((F.col(column) >= bound(low_us)) & (F.col(column) <= bound(high_us)))


def text_map(**columns: str) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.col(c).cast("string"))])


def event_samples(spark: SparkSession, sf_dir: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(event_type, user_id, ts, v): of a series' samples in one ms the latest event stays.  Of the days from low to high ms if given."""
    ev = read(spark, sf_dir, "events")
    if low is not None:
        ev = within(ev, "ts", low // DAY_MS * DAY_MS * 1000, (high + 1) * 1000)
    ev = ev.select("event_type", F.col("user_id").cast("string").alias("user_id"), millis("ts").alias("ts"), "event_id", "value")
    return ev.groupBy("event_type", "user_id", "ts").agg(F.max_by("value", "event_id").alias("v"))


DAY_MS = 86_400_000


def metrics(spark: SparkSession, sf_dir: str) -> Store:
    """Gauge ``event_value``, daily resetting counter ``event_counter``, classic histogram ``quantity_bucket`` and ``user_info``."""
    line = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    bounds = {"10": 10.0, "20": 20.0, "30": 30.0, "40": 40.0, "50": 50.0, "+Inf": float("inf")}
    sums = line.groupBy("l_returnflag").agg(*[F.sum((F.col("l_quantity") <= x).cast("double")).alias(text) for text, x in bounds.items()])
    counts = sums.select("l_returnflag", F.explode(F.array(*[F.struct(F.lit(t).alias("text"), F.col(t).alias("v")) for t in bounds])).alias("b")).select("l_returnflag", "b.text", "b.v")
    buckets = counts.select(F.lit("quantity_bucket").alias("name"), text_map(flag="l_returnflag", le="text").alias("labels"), F.lit(1705276800000).cast("long").alias("ts"), "v")
    users = event_samples(spark, sf_dir).select("user_id").distinct()
    info = users.select(F.lit("user_info").alias("name"), F.create_map(F.lit("user_id"), F.col("user_id"), F.lit("tier"), F.when(F.col("user_id").cast("long") % 2 == 0, "even").otherwise("odd")).alias("labels"), F.lit(1705276800000).cast("long").alias("ts"), F.lit(1.0).alias("v"))

    def between(low: int | None = None, high: int | None = None) -> DataFrame:
        g = event_samples(spark, sf_dir, low, high)
        day = Window.partitionBy("event_type", "user_id", F.expr(f"ts div {DAY_MS}")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        labels = text_map(event_type="event_type", user_id="user_id")
        gauge = g.select(F.lit("event_value").alias("name"), labels.alias("labels"), "ts", "v")
        counter = g.select(F.lit("event_counter").alias("name"), labels.alias("labels"), "ts", F.sum("v").over(day).alias("v"))
        return gauge.unionByName(counter).unionByName(buckets).unionByName(info)

    return Store(between(), between, event_histograms(spark, sf_dir))


def event_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native histogram counters ``event_size`` by event type: at each day's end the values seen so far, in buckets of powers of two."""
    ev = read(spark, sf_dir, "events").filter("value > 0").select("event_type", F.expr(f"({MILLIS} div {DAY_MS} + 1) * {DAY_MS}").alias("ts"), F.ceil(F.log2("value")).cast("int").alias("i"), "value")
    daily = ev.groupBy("event_type", "ts", "i").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s"))
    days = daily.groupBy("event_type", "ts").agg(F.collect_list(F.struct("i", "n")).alias("counts"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    so_far = Window.partitionBy("event_type").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    summed = days.select("event_type", "ts", F.flatten(F.collect_list("counts").over(so_far)).alias("seen"), F.sum("n").over(so_far).alias("count"), F.sum("s").over(so_far).alias("sum"))
    total = F.transform(F.array_distinct(F.transform("seen", lambda e: e["i"])), lambda i: F.struct(i.alias("i"), F.aggregate(F.filter("seen", lambda e: e["i"] == i), F.lit(0.0), lambda a, e: a + e["n"]).alias("n")))
    empty = F.create_map().cast("map<int,double>")
    return summed.select(
        F.lit("event_size").alias("name"), text_map(event_type="event_type").alias("labels"), "ts", F.lit(0).alias("schema"), F.lit(0.0).alias("zero_threshold"), F.lit(0.0).alias("zero_count"), "count", "sum",
        F.map_from_entries(total).alias("pos"), empty.alias("neg"), F.lit(None).cast("array<double>").alias("custom"),
    )


def log_lines(ev: DataFrame) -> DataFrame:
    """(labels, ts_ns, line, metadata): events as logfmt lines and as JSON lines."""
    ts = (micros("ts") * 1000).alias("ts_ns")
    fmt = F.format_string("type=%s user=%d value=%.2f took=%dms size=%dKB msg=\"event %d done\"", "event_type", "user_id", "value", (F.col("event_id") % 500).cast("long"), (F.col("event_id") % 7).cast("long"), "event_id")
    js = F.format_string('{"type":"%s","user":%d,"value":%.2f,"nested":{"k":%d}}', "event_type", "user_id", "value", (F.col("event_id") % 10).cast("long"))
    meta = F.create_map(F.lit("pod"), F.concat(F.lit("pod-"), (F.col("user_id") % 5).cast("string")))
    one = lambda app, line: ev.select(F.create_map(F.lit("app"), F.lit(app), F.lit("event_type"), F.col("event_type")).alias("labels"), ts, line.alias("line"), meta.alias("metadata"))
    return one("logfmt", fmt).unionByName(one("json", js))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(read(spark, sf_dir, "events"))


def log_table(spark: SparkSession, sf_dir: str) -> LogTable:
    """The log lines as a table that leaves out what lies outside a range of time."""
    ev = read(spark, sf_dir, "events")
    return LogTable(log_lines(ev), lambda low, high: log_lines(within(ev, "ts", low // 1000, high // 1000 + 1)))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each order: the order is the root, its lines are spans; a line with an even number is the child of the line before.

    Large tables are dealt out by trace before lines are grouped and joined: tasks of these steps hold shares that don't grow, and a scan only what its shuffle writer holds of a file split.
    """
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    tasks = tasks_for(li)
    start = micros("o_orderdate") * 1000
    root = o.select(
        F.col("o_orderkey").alias("trace_id"), F.lit(0).cast("long").alias("span_id"), F.lit(None).cast("long").alias("parent_span_id"), F.lit("order").alias("name"),
        F.lit("orders").alias("service"), start.alias("start_ns"), F.floor("o_totalprice").cast("long").alias("duration_ns"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("status"), F.lit(1).alias("kind"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")).alias("attrs"), F.create_map(F.lit("total"), F.col("o_totalprice")).alias("nums"),
    )
    cols = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"]
    li = dealt(li.select("l_orderkey", "l_linenumber", *cols), tasks, "l_orderkey")
    of = dealt(o.select(F.col("o_orderkey").alias("l_orderkey"), start.alias("t0")), tasks, "l_orderkey")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*cols)).alias("r")).select("l_orderkey", "l_linenumber", "r.*").join(of, "l_orderkey")
    child = li.select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("long").alias("span_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") - 1).otherwise(0).cast("long").alias("parent_span_id"), F.concat(F.lit("line-"), F.col("l_returnflag")).alias("name"),
        F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 3).cast("string")).alias("service"), (F.col("t0") + F.col("l_linenumber") * 1000).alias("start_ns"), (F.col("l_quantity") * 10).cast("long").alias("duration_ns"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("status"), F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(3).alias("kind"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("linestatus"), F.col("l_linestatus")).alias("attrs"), F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("price"), F.col("l_extendedprice")).alias("nums"),
    )
    return root.unionByName(child)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts_ms, labels, stack leaf to root, value): an order's price in the stack priority; segment; nation; region."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(
        millis("o_orderdate").alias("ts_ms"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("labels"), F.array("o_orderpriority", "c_mktsegment", "n_name", "r_name").alias("stack"),
        F.floor("o_totalprice").cast("long").alias("value"), F.col("o_orderkey").alias("span_id"), F.lit("sales:price:units:orders:count").alias("profile_type"),
    )
