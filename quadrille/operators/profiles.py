"""Profiles: merged stacks, trees, flame graphs, differences, series and heatmaps.

Samples are rows (ts_ms, labels, stack leaf to root, value, and, if there, profile_type, span_id, trace_id).  A tree is a table
(path root to leaf, self, total); only truncated trees, whose size a parameter bounds, become flame graphs on the driver.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import label, labels_of, matches
from ..plans.lexing import QueryError
from ..plans.promql import Parser

OTHER, ROOT = "other", "total"


def selector(text: str) -> tuple:
    """Matchers such as ``{service="a", env!="b"}``; braces may be left out."""
    p = Parser(text if text.lstrip().startswith("{") else "{" + text + "}")
    found = p.matchers()
    p.t.done()
    if len(found) != 1:
        raise QueryError("a profile selector has one list of matchers")
    return found[0]


def select(samples: DataFrame, text: str, start_ms: int, end_ms: int, profile_type: str | None = None, call_sites: list[str] = (), span_ids: list = (), trace_ids: list = ()) -> DataFrame:
    """Samples of the closed range that match; ``call_sites`` are the first frames from the root."""
    test = F.col("ts_ms").between(start_ms, end_ms)
    for k, op, v in selector(text):
        test &= matches(F.col("labels")[k], op, v)
    if profile_type is not None:
        test &= F.col("profile_type") == profile_type
    if call_sites:
        test &= F.slice(F.reverse("stack"), 1, len(call_sites)) == F.array(*[F.lit(c) for c in call_sites])
    if span_ids:
        test &= F.col("span_id").isin(list(span_ids))
    if trace_ids:
        test &= F.col("trace_id").isin(list(trace_ids))
    return samples.filter(test)


def merged(samples: DataFrame, group_by: list[str] = ()) -> DataFrame:
    """(path, value): sums of equal stacks; grouping labels become a frame below the root."""
    path = F.reverse("stack")
    if group_by:
        ls = labels_of(F.col("labels"))
        frame = F.concat_ws(", ", *[F.concat(F.lit(g + "="), F.coalesce(label(ls, g), F.lit(""))) for g in group_by])
        path = F.concat(F.array(frame), path)
    return samples.groupBy(path.alias("path")).agg(F.sum("value").alias("value"))


def tree(stacks: DataFrame) -> DataFrame:
    """(path, self, total) of every node but the root.  Stacks are summed before their prefixes are."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(F.slice("path", 1, n).alias("path"), (n == F.size("path")).alias("leaf")))
    each = stacks.filter(F.size("path") > 0).select("value", F.explode(prefixes).alias("p"))
    return each.groupBy("p.path").agg(F.sum(F.when(F.col("p.leaf"), F.col("value")).otherwise(0)).alias("self"), F.sum("value").alias("total"))


def truncated(nodes: DataFrame, max_nodes: int, ties: bool = True) -> DataFrame:
    """The nodes whose totals reach the (max_nodes - 1)-th largest, ties with it; what hangs below a kept node is summed in ``other``.

    Totals fall towards the leaves, so that a kept node's ancestors are kept.  Without ``ties``, of equal totals those nearer to the
    root stay, then by path, and max_nodes - 1 nodes are kept at most.
    """
    place = F.struct((-F.col("total")).alias("t"), F.when(F.lit(ties), 0).otherwise(F.size("path")).alias("n"), F.when(F.lit(not ties), F.col("path")).alias("p"))
    ordered = nodes.select(place.alias("place")).orderBy("place").limit(max(0, max_nodes - 1))
    top = ordered.agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
    marked = nodes.withColumn("place", place).join(F.broadcast(top))  # one row
    kept = F.coalesce((F.col("n") < max_nodes - 1) | (F.col("place") <= F.col("last")), F.lit(False))
    parent = F.slice("path", 1, F.size("path") - 1)
    dropped = marked.filter(~kept).groupBy(parent.alias("path")).agg(F.sum("total").alias("other"))
    out = marked.filter(kept).select("path", "self", "total").join(dropped, "path", "left").withColumn("other", F.coalesce("other", F.lit(0)))
    root = dropped.filter(F.size("path") == 0).select("path", F.lit(0).cast("long").alias("self"), F.lit(0).cast("long").alias("total"), "other")
    return out.unionByName(root)


#: With so many times the nodes asked for in ties, ties are cut; and the nodes of a picture without a limit.
TIES, MOST_NODES = 16, 200_000


def flamegraph(samples: DataFrame, max_nodes: int = 1024, group_by: list[str] = ()) -> dict:
    """names, levels of four numbers a bar (gap to the bar before, total, self, name), total and the largest self.

    The driver gets TIES * max_nodes nodes at most.
    """
    stacks = merged(samples, group_by)
    rows = truncated(tree(stacks), max_nodes).limit(TIES * max_nodes + 1).collect()
    if len(rows) > TIES * max_nodes:
        rows = truncated(tree(stacks), max_nodes, ties=False).collect()
    children: dict[tuple, dict[str, tuple]] = defaultdict(dict)
    rest = {}
    for r in rows:
        p = tuple(r.path)
        rest[p] = r.other
        if p:
            children[p[:-1]][p[-1]] = (r.total, r["self"])
    total = sum(t for t, _ in children[()].values()) + rest.get((), 0)
    names, number = [ROOT], {ROOT: 0}
    levels: list[list[int]] = []
    level = [((), ROOT, total, 0, 0)]
    largest = 0
    while level:
        values, end, below = [], 0, []
        for path, name, t, s, x in level:
            number.setdefault(name, len(number))
            values += [x - end, t, s, number[name]]
            end, largest = x + t, max(largest, s)
            if path is None:
                continue
            at = x + s
            for child, (ct, cs) in sorted(children.get(path, {}).items()):
                below.append(((*path, child), child, ct, cs, at))
                at += ct
            if rest.get(path):
                below.append((None, OTHER, rest[path], rest[path], at))
        levels.append(values)
        level = below
    names = sorted(number, key=number.get)
    return {"names": names, "levels": levels, "total": total, "max_self": largest}


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, self_left, total_left, self_right, total_right) of two trees."""
    sides = []
    for side, nodes in (("left", left), ("right", right)):
        zero = F.lit(0).cast("long")
        own = {f"{c}_{o}": F.col(c).cast("long") if o == side else zero for c in ("self", "total") for o in ("left", "right")}
        sides.append(nodes.select("path", *[c.alias(k) for k, c in own.items()]))
    return sides[0].unionByName(sides[1]).groupBy("path").agg(*[F.sum(c).alias(c) for c in ("self_left", "total_left", "self_right", "total_right")])


def diff_flamegraph(left: DataFrame, right: DataFrame, max_nodes: int = 1024) -> dict:
    """Seven numbers a bar (gap, total, self of the left, the same of the right, name).  Nodes are kept by rank of
    both totals, then name, with their ancestors, while they fit; the others are summed as ``other``.  With max_nodes 0 all are kept,
    up to MOST_NODES; more are an error."""
    both = diff(left, right)
    # a node's ancestors rank before it or tie with it; twice as many rows as nodes are more than enough to decide
    total = F.col("total_left") + F.col("total_right")
    rows = both.orderBy(total.desc(), F.element_at("path", -1), F.size("path"), "path").limit(2 * max_nodes).collect() if max_nodes > 0 else both.limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES and max_nodes <= 0:
        raise ValueError(f"more than {MOST_NODES} nodes; give a limit")
    known = {tuple(r.path): r for r in rows}
    kept: set[tuple] = set()
    for p in known:
        path = [p[:k] for k in range(1, len(p) + 1) if p[:k] not in kept]
        if (max_nodes <= 0 or len(kept) + 1 + len(path) <= max_nodes) and all(q in known for q in path):
            kept.update(path)
    top = both.filter(F.size("path") == 1).agg(F.sum("total_left").alias("l"), F.sum("total_right").alias("r")).first()
    children = defaultdict(list)
    for p in sorted(kept):
        children[p[:-1]].append(p)
    number = {ROOT: 0}
    level = [((), ROOT, top.l or 0, 0, top.r or 0, 0, 0, 0)]
    levels = []
    while level:
        values, below, end_l, end_r = [], [], 0, 0
        for path, name, tl, sl, tr, sr, xl, xr in level:
            number.setdefault(name, len(number))
            values += [xl - end_l, tl, sl, xr - end_r, tr, sr, number[name]]
            end_l, end_r = xl + tl, xr + tr
            if path is None:
                continue
            at_l, at_r = xl + sl, xr + sr
            for child in children.get(path, ()):
                r = known[child]
                below.append((child, child[-1], r.total_left, r.self_left, r.total_right, r.self_right, at_l, at_r))
                at_l, at_r = at_l + r.total_left, at_r + r.total_right
            left_over, right_over = xl + tl - at_l, xr + tr - at_r
            if left_over or right_over:
                below.append((None, OTHER, left_over, left_over, right_over, right_over, at_l, at_r))
        levels.append(values)
        level = below
    return {"names": sorted(number, key=number.get), "levels": levels, "left_ticks": top.l or 0, "right_ticks": top.r or 0}


def bucket_end(ts: Column, start_ms: int, end_ms: int, step_ms: int) -> Column:
    """The right end of a sample's bucket on the grid from ``start_ms``, whose first bucket reaches one step back; null outside."""
    steps = F.call_function("div", F.greatest(ts - start_ms, F.lit(0).cast("long")) + (step_ms - 1), F.lit(step_ms))
    end = start_ms + steps * step_ms
    return F.when((ts >= start_ms - step_ms) & (ts <= end_ms) & (end <= end_ms), end)


def series(samples: DataFrame, start_ms: int, end_ms: int, step_ms: int, group_by: list[str] = (), aggregation: str = "sum") -> DataFrame:
    """(labels, ts_ms, value): sums, or means over profiles, of the profiles' totals by bucket."""
    ls = labels_of(F.col("labels"))
    profiles = samples.groupBy(ls.alias("series"), "ts_ms").agg(F.sum("value").alias("total"))
    group = F.filter("series", lambda e: e["k"].isin(list(group_by))) if group_by else F.array().cast("array<struct<k:string,v:string>>")
    placed = profiles.select(group.alias("g"), bucket_end(F.col("ts_ms"), start_ms, end_ms, step_ms).alias("ts_ms"), "total").filter("ts_ms is not null")
    agg = F.sum("total") if aggregation == "sum" else F.avg("total")
    return placed.groupBy("g", "ts_ms").agg(agg.cast("double").alias("value")).select(F.map_from_entries("g").alias("labels"), "ts_ms", "value")


def heatmap(points: DataFrame, start_ms: int, end_ms: int, time_buckets: int, value_buckets: int) -> DataFrame:
    """(time_bucket, value_bucket, n) of points (ts_ms, total): equal widths, times in [start, end), values over all points' range."""
    bounds = points.agg(F.min("total").alias("low"), F.max("total").alias("high"))
    placed = points.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms)).join(F.broadcast(bounds))  # one row
    t = F.call_function("div", (F.col("ts_ms") - start_ms) * time_buckets, F.lit(end_ms - start_ms))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1))
    v = F.least(F.call_function("div", (F.col("total") - F.col("low")) * value_buckets, span), F.lit(value_buckets - 1))
    v = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(v)
    return placed.groupBy(t.cast("int").alias("time_bucket"), v.cast("int").alias("value_bucket")).agg(F.count(F.lit(1)).alias("n"))


def profile_totals(samples: DataFrame) -> DataFrame:
    """(labels, ts_ms, total) of each profile."""
    g = samples.groupBy(labels_of(F.col("labels")).alias("ls"), "ts_ms").agg(F.sum("value").alias("total"))
    return g.select(F.map_from_entries("ls").alias("labels"), "ts_ms", "total")


def profile_types(samples: DataFrame) -> DataFrame:
    return samples.select("profile_type").distinct()


def label_values(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode("labels").alias("name", "value")).distinct()


def stats(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.min("ts_ms").alias("oldest_ms"), F.max("ts_ms").alias("newest_ms"), F.sum("value").alias("total"))


def recorded(samples: DataFrame, metric: str, matchers: str, group_by: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """A recording rule: (name, labels, ts, v) totals of the selected profiles by labels."""
    chosen = select(samples, matchers, start_ms, end_ms)
    ls = F.filter(labels_of(F.col("labels")), lambda e: e["k"].isin(list(group_by)))
    g = chosen.groupBy(ls.alias("ls")).agg(F.sum("value").cast("double").alias("v"))
    return g.select(F.lit(metric).alias("name"), F.map_from_entries("ls").alias("labels"), F.lit(end_ms).alias("ts"), "v")
