"""Registered profile queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import profiles
from .sources import signals

DAY = 86_400_000
START = 788_918_400_000  # 1995
STEP = 100 * DAY
END = START + 30 * STEP
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
BASE = f"""
WITH s AS (
  SELECT (epoch_us(o_orderdate) // 1000)::BIGINT AS ts, o_orderstatus AS status, r_name AS f1, n_name AS f2, c_mktsegment AS f3, o_orderpriority AS f4, floor(o_totalprice)::BIGINT AS v, o_orderkey AS span_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE epoch_us(o_orderdate) // 1000 BETWEEN {START} AND {END}),
pre AS (
  SELECT status, f1 AS path, 0::BIGINT AS self, v, ts, 1 AS d FROM s UNION ALL SELECT status, f1 || ';' || f2, 0, v, ts, 2 FROM s
  UNION ALL SELECT status, f1 || ';' || f2 || ';' || f3, 0, v, ts, 3 FROM s UNION ALL SELECT status, f1 || ';' || f2 || ';' || f3 || ';' || f4, v, v, ts, 4 FROM s)
"""


def case(name: str, run: Callable[[DataFrame], DataFrame], sql: str, text: str = "{}", **how) -> None:
    CASES[f"profile_{name}"] = (lambda spark, sf_dir: run(profiles.select(signals.profiles(spark, sf_dir), text, START, END, **how)), BASE + sql)


def flat(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.array_join("path", ";").alias("path"), *[c for c in nodes.columns if c != "path"])


TREE = "SELECT path, sum(self)::BIGINT AS self, sum(v)::BIGINT AS total FROM pre GROUP BY path"
case("merge", lambda d: flat(profiles.tree(profiles.merged(d))), TREE)
case("merge_selector", lambda d: flat(profiles.tree(profiles.merged(d))), TREE.replace("GROUP", "WHERE status IN ('F', 'O') GROUP"), '{status=~"F|O", none=""}')
case("merge_grouped", lambda d: flat(profiles.tree(profiles.merged(d, ["status"]))), "SELECT 'status=' || status || ';' || path AS path, sum(self)::BIGINT AS self, sum(v)::BIGINT AS total FROM pre GROUP BY ALL UNION ALL SELECT 'status=' || status, 0, sum(v)::BIGINT FROM s GROUP BY status")
case("callsite", lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "SELECT count(*) AS n, sum(v)::BIGINT AS total FROM s WHERE f1 = 'ASIA'", call_sites=["ASIA"])
case("span", lambda d: flat(profiles.merged(d)), "SELECT f1 || ';' || f2 || ';' || f3 || ';' || f4 AS path, sum(v)::BIGINT AS value FROM s WHERE span_id IN (1, 2, 3, 5, 8) GROUP BY ALL", span_ids=[1, 2, 3, 5, 8])
case("truncated", lambda d: flat(profiles.truncated(profiles.tree(profiles.merged(d)), 25)).filter("path <> ''"), """, t AS (SELECT path, max(d) AS d, sum(self)::BIGINT AS self, sum(v)::BIGINT AS total FROM pre GROUP BY path),
m AS (SELECT min(total) AS least FROM (SELECT total FROM t ORDER BY total DESC LIMIT 24)),
k AS (SELECT * FROM t, m WHERE total >= least), o AS (SELECT regexp_replace(path, ';[^;]*$', '') AS path, sum(total)::BIGINT AS other FROM t, m WHERE total < least AND d > 1 GROUP BY ALL)
SELECT path, self, total, coalesce(other, 0) AS other FROM k LEFT JOIN o USING (path)""")
case("diff", lambda d: flat(profiles.diff(profiles.tree(profiles.merged(d.filter("labels['status'] = 'F'"))), profiles.tree(profiles.merged(d.filter("labels['status'] = 'O'"))))), "SELECT path, sum(self) FILTER (status = 'F')::BIGINT AS self_left, sum(v) FILTER (status = 'F')::BIGINT AS total_left, sum(self) FILTER (status = 'O')::BIGINT AS self_right, sum(v) FILTER (status = 'O')::BIGINT AS total_right FROM (SELECT * FROM pre UNION ALL SELECT 'F', path, 0, 0, ts, d FROM pre WHERE status = 'O' UNION ALL SELECT 'O', path, 0, 0, ts, d FROM pre WHERE status = 'F') WHERE status IN ('F', 'O') GROUP BY path")
BUCKET = f"({START} + (greatest(ts - {START}, 0) + {STEP} - 1) // {STEP} * {STEP})::BIGINT"
for agg in ("sum", "avg"):
    case(f"series_{agg}", lambda d, agg=agg: profiles.series(d, START, END, STEP, ["status"], "sum" if agg == "sum" else "average").select(F.col("labels")["status"].alias("status"), "ts_ms", F.round("value", 6).alias("value")), f"SELECT status, {BUCKET} AS ts_ms, round({agg}(v), 6)::DOUBLE AS value FROM (SELECT status, ts, sum(v) AS v FROM s GROUP BY ALL) WHERE {BUCKET} <= {END} GROUP BY ALL")
case("heatmap", lambda d: profiles.heatmap(profiles.profile_totals(d), START, END, 20, 10), f", p AS (SELECT status, ts, sum(v)::BIGINT AS t FROM s GROUP BY ALL), b AS (SELECT min(t) AS lo, max(t) AS hi FROM p) SELECT ((ts - {START}) * 20 // {END - START})::INT AS time_bucket, least((t - lo) * 10 // (hi - lo), 9)::INT AS value_bucket, count(*) AS n FROM p, b WHERE ts < {END} GROUP BY ALL")
case("types", profiles.profile_types, "SELECT 'sales:price:units:orders:count' AS profile_type", profile_type="sales:price:units:orders:count")
case("labels", profiles.label_values, "SELECT DISTINCT 'status' AS name, status AS value FROM s")
case("stats", profiles.stats, "SELECT count(*) AS samples, min(ts) AS oldest_ms, max(ts) AS newest_ms, sum(v)::BIGINT AS total FROM s")
CASES["profile_recording_rule"] = (
    lambda spark, sf_dir: profiles.recorded(signals.profiles(spark, sf_dir), "sales_total", '{status!="P"}', ["status"], START, END).select("name", F.col("labels")["status"].alias("status"), "ts", "v"),
    BASE + f"SELECT 'sales_total' AS name, status, {END}::BIGINT AS ts, sum(v)::DOUBLE AS v FROM s WHERE status <> 'P' GROUP BY status",
)
