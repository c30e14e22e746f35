"""Registered trace queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.spans import with_nested_sets
from .plans import traceql
from .sources import signals

DAY = 86_400_000_000_000
START, STEP, POINTS = 631_152_000_000_000_000, 400 * DAY, 15
END = START + (POINTS - 1) * STEP + STEP - 1
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
#: The spans; pairs of a span and its parent; pairs of a span and each of its ancestors.
BASE = """
WITH li AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) = 1),
spans AS MATERIALIZED (
  SELECT o_orderkey AS trace_id, 0::BIGINT AS span_id, NULL::BIGINT AS parent, 'order' AS name, 'orders' AS service, epoch_us(o_orderdate) * 1000 AS start_ns, floor(o_totalprice)::BIGINT AS duration_ns,
    CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS status, 1 AS kind, o_orderpriority AS priority, o_orderstatus AS ostatus, NULL AS flag, NULL AS linestatus, o_totalprice AS total, NULL::DOUBLE AS quantity, NULL::DOUBLE AS price
  FROM orders
  UNION ALL
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 1 ELSE 0 END, 'line-' || l_returnflag, 'supplier-' || (l_suppkey % 3)::VARCHAR, epoch_us(o_orderdate) * 1000 + l_linenumber * 1000, (l_quantity * 10)::BIGINT,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 3 END, NULL, NULL, l_returnflag, l_linestatus, NULL, l_quantity, l_extendedprice
  FROM li JOIN orders ON l_orderkey = o_orderkey),
par AS (SELECT c.trace_id, c.span_id, p.span_id AS up FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent),
anc AS (SELECT * FROM par UNION ALL SELECT a.trace_id, a.span_id, b.up FROM par a JOIN par b ON b.trace_id = a.trace_id AND b.span_id = a.up),
fam AS (SELECT s.trace_id, s.span_id, coalesce(up, -1) AS up FROM spans s LEFT JOIN par USING (trace_id, span_id))
"""


def find(name: str, text: str, sql: str) -> None:
    """The identities of the matching spans."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return traceql.find(signals.spans(spark, sf_dir), text, START, END).select("trace_id", "span_id")

    CASES[f"traceql_{name}"] = (run, BASE + sql)


def metric(name: str, text: str, labels: list[str], sql: str, digits: int = 9) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = traceql.metrics(signals.spans(spark, sf_dir), text, START, END, STEP)
        return df.select(*[F.col("labels")[k].alias(k) for k in labels], "ts_ns", F.round("value", digits).alias("value"))

    CASES[f"traceql_{name}"] = (run, BASE + sql)


ONE = "SELECT trace_id, span_id FROM spans WHERE "
find("selector", '{ .flag = "R" && duration > 300 }', ONE + "flag = 'R' AND duration_ns > 300")
find("not_equal", '{ .flag != "R" }', ONE + "flag <> 'R'")
find("regex", '{ name =~ "line-[AN]" && .linestatus !~ "F" }', ONE + "name IN ('line-A', 'line-N') AND linestatus <> 'F'")
find("nil", '{ .flag = nil }', ONE + "flag IS NULL")
find("present", '{ .quantity != nil }', ONE + "quantity IS NOT NULL")
find("numbers", '{ .quantity >= 25 && .quantity < 30.5 }', ONE + "quantity >= 25 AND quantity < 30.5")
find("arithmetic", '{ .price / .quantity > 1500 || -(.quantity ^ 2) % 7 = -4 }', ONE + "price / quantity > 1500 OR (quantity * quantity)::BIGINT % 7 = 4")
find("negation", '{ !(.flag = "R") && (.linestatus = "O" || .quantity > 49) }', ONE + "(flag <> 'R' OR flag IS NULL) AND (linestatus = 'O' OR quantity > 49)")
find("field_comparison", '{ .price > duration }', ONE + "price > duration_ns")
find("status_kind", '{ status = error && kind = server }', ONE + "status = 2 AND kind = 2")
find("duration_units", '{ span:duration >= 250us }', ONE + "duration_ns >= 250000")
find("service", '{ resource.service.name = "supplier-1" && span.linestatus = "O" }', ONE + "service = 'supplier-1' AND linestatus = 'O'")
find("parent_scope", '{ parent.flag = "R" && .flag = "A" }', "SELECT c.trace_id, c.span_id FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent WHERE p.flag = 'R' AND c.flag = 'A'")
find("child_count", '{ span:childCount >= 3 }', "SELECT trace_id, parent AS span_id FROM spans WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND (trace_id, parent) IN (SELECT (trace_id, span_id) FROM spans)")
find("trace_facts", '{ rootServiceName = "orders" && trace:duration > 400us && .flag = "N" }', "SELECT s.trace_id, s.span_id FROM spans s JOIN (SELECT trace_id FROM spans GROUP BY trace_id HAVING max(start_ns + duration_ns) - min(start_ns) > 400000) USING (trace_id) WHERE flag = 'N'")
find("spanset_and", '{ .flag = "R" } && { .priority = "1-URGENT" }', ", r AS (SELECT DISTINCT trace_id FROM spans WHERE flag = 'R'), u AS (SELECT DISTINCT trace_id FROM spans WHERE priority = '1-URGENT') SELECT trace_id, span_id FROM spans JOIN r USING (trace_id) JOIN u USING (trace_id) WHERE flag = 'R' OR priority = '1-URGENT'")
find("spanset_or", '{ .flag = "R" } || { .priority = "1-URGENT" }', ONE + "flag = 'R' OR priority = '1-URGENT'")
A, B = "flag = 'R'", "linestatus = 'O'"
QA, QB = '{ .flag = "R" }', '{ .linestatus = "O" }'
#: For each operator: pairs of the right side's span (x) and the left side's (y).
PAIRS = {
    ">>": ("descendant", "SELECT trace_id, span_id AS x, up AS y FROM anc"), "<<": ("ancestor", "SELECT trace_id, up AS x, span_id AS y FROM anc"),
    ">": ("child", "SELECT trace_id, span_id AS x, up AS y FROM par"), "<": ("parent", "SELECT trace_id, up AS x, span_id AS y FROM par"),
    "~": ("sibling", "SELECT a.trace_id, a.span_id AS x, b.span_id AS y FROM fam a JOIN fam b ON a.trace_id = b.trace_id AND a.up = b.up AND a.span_id <> b.span_id"),
}
for op, (name, pairs) in PAIRS.items():
    met = f", met AS (SELECT m.trace_id, x, y FROM ({pairs}) m JOIN spans a ON a.trace_id = m.trace_id AND a.span_id = y AND a.{A} JOIN spans b ON b.trace_id = m.trace_id AND b.span_id = x AND b.{B}) "
    find(name, f"{QA} {op} {QB}", met + "SELECT DISTINCT trace_id, x AS span_id FROM met")
    find(f"not_{name}", f"{QA} !{op} {QB}", met + f"SELECT trace_id, span_id FROM spans s WHERE {B} AND NOT EXISTS (SELECT 1 FROM met WHERE met.trace_id = s.trace_id AND met.x = s.span_id)")
    find(f"union_{name}", f"{QA} &{op} {QB}", met + "SELECT trace_id, x AS span_id FROM met UNION SELECT trace_id, y FROM met")
find("structural_chain", '({ name = "order" } > { .flag = "R" }) > { .flag = "A" }', "SELECT c.trace_id, c.span_id FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent WHERE p.flag = 'R' AND p.parent = 0 AND c.flag = 'A'")
for fn, text, sql in (("count", "count() > 3", "count(*) > 3"), ("avg", "avg(.quantity) > 35", "avg(quantity) > 35"), ("sum", "sum(.price) >= 100000", "sum(price) >= 100000"), ("min", "min(duration) < 20", "min(duration_ns) < 20"), ("max", "max(.quantity) = 50", "max(quantity) = 50")):
    find(f"{fn}_filter", "{ .quantity > 0 } | " + text, f"SELECT trace_id, span_id FROM spans WHERE quantity > 0 AND trace_id IN (SELECT trace_id FROM spans WHERE quantity > 0 GROUP BY trace_id HAVING {sql})")
find("by_filter", '{ .quantity > 0 } | by(.flag) | count() > 1', "SELECT trace_id, span_id FROM spans WHERE quantity > 0 QUALIFY count(*) OVER (PARTITION BY trace_id, flag) > 1")
find("by_expression", '{ .quantity > 0 } | by(.quantity % 2) | count() > 2', "SELECT trace_id, span_id FROM spans WHERE quantity > 0 QUALIFY count(*) OVER (PARTITION BY trace_id, fmod(quantity, 2)) > 2")
find("coalesce", '{ .quantity > 0 } | by(.flag) | coalesce() | count() > 4', "SELECT trace_id, span_id FROM spans WHERE quantity > 0 QUALIFY count(*) OVER (PARTITION BY trace_id) > 4")
find("second_selector", '{ .quantity > 0 } | { .flag = "R" } | count() > 1', "SELECT trace_id, span_id FROM spans WHERE flag = 'R' QUALIFY count(*) OVER (PARTITION BY trace_id) > 1")
find("group_topk", '{ .price > 0 } | by(.flag) | sum(.price) | topk(5)', "SELECT s.trace_id, s.span_id FROM spans s JOIN (SELECT trace_id, flag FROM spans WHERE price > 0 GROUP BY ALL ORDER BY sum(price) DESC, flag, trace_id LIMIT 5) g ON s.trace_id = g.trace_id AND s.flag = g.flag WHERE s.price > 0")
B_ = f"((start_ns - {START}) // {STEP} * {STEP} + {START})::BIGINT AS ts_ns"
GRID = f", pts AS (SELECT unnest(range({START}, {END} + 1, {STEP}))::BIGINT AS ts_ns), fs AS (SELECT DISTINCT flag FROM spans WHERE flag IS NOT NULL)"
metric("metrics_rate", "{ .flag != nil } | rate() by (span.flag)", ["span.flag"], GRID + f", c AS (SELECT flag, {B_}, count(*) AS n FROM spans WHERE flag IS NOT NULL GROUP BY ALL) SELECT flag AS \"span.flag\", ts_ns, round(coalesce(n, 0) / {STEP / 1e9}, 12)::DOUBLE AS value FROM fs CROSS JOIN pts LEFT JOIN c USING (flag, ts_ns)", 12)
metric("metrics_count", "{ .flag != nil } | count_over_time() by (span.flag)", ["span.flag"], GRID + f", c AS (SELECT flag, {B_}, count(*) AS n FROM spans WHERE flag IS NOT NULL GROUP BY ALL) SELECT flag AS \"span.flag\", ts_ns, coalesce(n, 0)::DOUBLE AS value FROM fs CROSS JOIN pts LEFT JOIN c USING (flag, ts_ns)")
for fn in ("sum", "avg", "min", "max"):
    metric(f"metrics_{fn}", "{ .flag != nil } | " + f"{fn}_over_time(.quantity) by (.flag, status)", [".flag", "status"], f"SELECT flag AS \".flag\", CASE status WHEN 1 THEN 'ok' ELSE 'error' END AS status, {B_}, round({fn}(quantity), 9)::DOUBLE AS value FROM spans WHERE flag IS NOT NULL GROUP BY ALL")
POW = "CASE WHEN (1 << (ceil(log2(duration_ns))::INT - 1)) >= duration_ns THEN 1 << (ceil(log2(duration_ns))::INT - 1) ELSE 1 << ceil(log2(duration_ns))::INT END::DOUBLE / 1e9"
metric("metrics_histogram", '{ name = "line-R" } | histogram_over_time(duration)', ["__bucket"], GRID + f", c AS (SELECT {POW} AS p, {B_}, count(*) AS n FROM spans WHERE flag = 'R' AND duration_ns >= 2 GROUP BY ALL) SELECT rtrim(rtrim(format('{{:.9f}}', p), '0'), '.') AS __bucket, pts.ts_ns, coalesce(n, 0)::DOUBLE AS value FROM (SELECT DISTINCT p FROM c) CROSS JOIN pts LEFT JOIN c USING (p, ts_ns)")
metric("metrics_quantile", '{ name = "line-R" } | quantile_over_time(duration, .5, .9)', ["p"], GRID + f""", c AS (SELECT {POW} AS v, {B_}, count(*) AS n FROM spans WHERE flag = 'R' AND duration_ns >= 2 GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY ts_ns ORDER BY v) AS upto, sum(n) OVER (PARTITION BY ts_ns) AS total, lag(v) OVER (PARTITION BY ts_ns ORDER BY v) AS pv FROM c),
h AS (SELECT q, ts_ns, CASE WHEN total = 1 OR greatest(ceil(q * total), 1) = upto THEN v ELSE pow(2, coalesce(log2(pv), log2(v) - 1) + (log2(v) - coalesce(log2(pv), log2(v) - 1)) * (greatest(ceil(q * total), 1) - upto + n) / n) END AS value
  FROM w, (SELECT unnest([0.5, 0.9])::DOUBLE AS q) WHERE upto >= greatest(ceil(q * total), 1) AND upto - n < greatest(ceil(q * total), 1))
SELECT q::VARCHAR AS p, pts.ts_ns, round(coalesce(value, 0), 12)::DOUBLE AS value FROM (SELECT unnest([0.5, 0.9])::DOUBLE AS q) CROSS JOIN pts LEFT JOIN h USING (q, ts_ns)""", 12)
metric("topk_metric", "{ } | count_over_time() by (name) | topk(2)", ["name"], f"SELECT * FROM (SELECT name, {B_}, count(*)::DOUBLE AS value FROM spans GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ts_ns ORDER BY value DESC, name) <= 2")
metric("bottomk_metric", "{ } | count_over_time() by (name) | bottomk(2)", ["name"], f"SELECT * FROM (SELECT name, {B_}, count(*)::DOUBLE AS value FROM spans GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ts_ns ORDER BY value, name DESC) <= 2")
metric("metric_filter", "{ } | count_over_time() by (name) > 1000", ["name"], f"SELECT name, {B_}, count(*)::DOUBLE AS value FROM spans GROUP BY ALL HAVING count(*) > 1000")
metric("metrics_structural", '{ name = "order" } > { .flag = "R" } | count_over_time()', [], GRID + f", c AS (SELECT {B_}, count(*) AS n FROM spans WHERE flag = 'R' AND parent = 0 GROUP BY ALL) SELECT pts.ts_ns, coalesce(n, 0)::DOUBLE AS value FROM pts LEFT JOIN c USING (ts_ns)")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = signals.spans(spark, sf_dir).drop("nums")
    df = traceql.metrics(spans, '{ name = "order" } | compare({ status = error }, 3)', START, END, END - START + 1)
    pair = F.filter(F.map_entries("labels"), lambda e: e["key"] != "__meta_type")
    return df.select(F.col("labels")["__meta_type"].alias("meta"), F.get(pair, 0)["key"].alias("attribute"), F.get(pair, 0)["value"].alias("x"), "value")


CASES["traceql_compare"] = (compared, BASE + """, o AS (SELECT status = 2 AS sel, unnest([{'k': 'name', 'x': name}, {'k': 'kind', 'x': 'internal'}, {'k': 'status', 'x': CASE status WHEN 2 THEN 'error' ELSE 'ok' END}, {'k': 'span.priority', 'x': priority}, {'k': 'span.status', 'x': ostatus}, {'k': 'resource.service.name', 'x': service}]) AS e FROM spans WHERE name = 'order'),
c AS (SELECT * FROM (SELECT e.k AS attribute, e.x AS x, count(*) FILTER (sel) AS s, count(*) FILTER (NOT sel) AS b FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY s DESC, x) <= 3)
SELECT 'selection' AS meta, attribute, x, s::DOUBLE AS value FROM c UNION ALL SELECT 'baseline', attribute, x, b::DOUBLE FROM c
UNION ALL SELECT CASE WHEN status = 2 THEN 'selection_total' ELSE 'baseline_total' END, NULL, NULL, count(*)::DOUBLE FROM spans WHERE name = 'order' GROUP BY ALL""")
CASES["traceql_search"] = (
    lambda spark, sf_dir: traceql.search(signals.spans(spark, sf_dir), '{ .flag = "R" }', START, END, limit=20).select("trace_id", "start_ns", "matched", F.size("spans").alias("shown")),
    BASE + "SELECT trace_id, min(start_ns) AS start_ns, count(*) AS matched, least(count(*), 3)::INT AS shown FROM spans WHERE flag = 'R' GROUP BY trace_id ORDER BY min(start_ns) DESC, trace_id LIMIT 20",
)
CASES["traceql_trace_by_id"] = (lambda spark, sf_dir: traceql.trace_by_id(signals.spans(spark, sf_dir), 7).select("trace_id", "span_id", "name"), BASE + "SELECT trace_id, span_id, name FROM spans WHERE trace_id = 7")
CASES["traceql_tags"] = (lambda spark, sf_dir: traceql.tag_names(signals.spans(spark, sf_dir)), "SELECT 'span' AS scope, unnest(['priority', 'status', 'flag', 'linestatus', 'total', 'quantity', 'price']) AS tag")
CASES["traceql_tag_values"] = (lambda spark, sf_dir: traceql.tag_values(signals.spans(spark, sf_dir), "resource.service.name", '{ .flag = "R" }', START, END), BASE + "SELECT DISTINCT service AS value FROM spans WHERE flag = 'R'")
CASES["traceql_nested_sets"] = (
    lambda spark, sf_dir: with_nested_sets(signals.spans(spark, sf_dir)).select("trace_id", "span_id", (F.col("ns_right") - F.col("ns_left")).alias("width"), (F.col("ns_parent") < 0).alias("is_root")),
    BASE + "SELECT s.trace_id, s.span_id, (2 * count(a.span_id) + 1)::INT AS width, NOT EXISTS (SELECT 1 FROM par p WHERE p.trace_id = s.trace_id AND p.span_id = s.span_id) AS is_root FROM spans s LEFT JOIN anc a ON a.trace_id = s.trace_id AND a.up = s.span_id GROUP BY ALL",
)
MS0, WIDTH = START // 1_000_000, max(1, (END // 1_000_000 - START // 1_000_000) // 50)
CASES["traceql_exemplars"] = (
    lambda spark, sf_dir: traceql.exemplars(signals.spans(spark, sf_dir), '{ .flag = "R" }', START, END),
    BASE + f"SELECT trace_id, span_id, start_ns, duration_ns FROM spans WHERE flag = 'R' QUALIFY row_number() OVER (PARTITION BY least((start_ns // 1000000 - {MS0}) // {WIDTH}, 49) ORDER BY md5(concat(trace_id, '/', span_id)), trace_id, span_id) <= 2",
)
CASES["traceql_search_select"] = (
    lambda spark, sf_dir: traceql.search(signals.spans(spark, sf_dir), '{ .quantity > 45 } | select(.flag, .linestatus)', START, END, limit=50, spans_per_set=2).select("trace_id", "matched", F.array_join(F.transform("spans", lambda x: F.concat(x["name"], F.lit(":"), x[".flag"], x[".linestatus"])), ",").alias("shown")),
    BASE + ", m AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id) AS k FROM spans WHERE quantity > 45) SELECT trace_id, count(*) AS matched, string_agg(name || ':' || flag || linestatus, ',' ORDER BY start_ns, span_id) FILTER (k <= 2) AS shown FROM m GROUP BY trace_id ORDER BY min(start_ns) DESC, trace_id LIMIT 50",
)
