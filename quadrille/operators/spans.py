"""Span tables: one row layout, tree numbering, and parent and trace facts.

Layout: trace_id, span_id, parent_span_id, name, kind, start_ns, duration_ns, status, status_message, service, instrumentation_name,
instrumentation_version, attrs (strings), nums, bools, lists (repeated strings), resource, events, links.  Columns that a table lacks are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tasks import dealt, tasks_for

OPTIONAL = {
    "kind": "int", "status": "int", "status_message": "string", "service": "string", "instrumentation_name": "string", "instrumentation_version": "string",
    "attrs": "map<string,string>", "nums": "map<string,double>", "bools": "map<string,boolean>", "lists": "map<string,array<string>>", "resource": "map<string,string>",
    "events": "array<struct<name:string,time_since_start_ns:bigint,attrs:map<string,string>>>", "links": "array<struct<trace_id:string,span_id:string,attrs:map<string,string>>>",
}
#: Names of the codes.
STATUS = ("unset", "ok", "error")
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")


def laid_out(spans: DataFrame) -> DataFrame:
    return spans.withColumns({k: F.lit(None).cast(t) for k, t in OPTIONAL.items() if k not in spans.columns})


def number_trace(ids: list, parents: list) -> tuple[list[int], list[int], list[int]]:
    """(left, right, parent's left) by depth-first order; a span whose parent is missing or itself is a root, with parent -1.

    Spans that only a cycle of parents reaches start trees of their own, in row order.
    """
    n, at = len(ids), {s: k for k, s in enumerate(ids)}
    children: list[list[int]] = [[] for _ in range(n)]
    roots = []
    for k, p in enumerate(parents):
        j = at.get(p) if p is not None else None
        if j is None or j == k:
            roots.append(k)
        else:
            children[j].append(k)
    left, right, above = [0] * n, [0] * n, [-1] * n
    clock = 1
    for start in (*roots, *range(n)):
        if left[start]:
            continue
        left[start] = clock
        clock += 1
        path, turn = [start], [0]
        while path:
            k, c = path[-1], turn[-1]
            if c == len(children[k]):
                right[k] = clock
                clock += 1
                path.pop()
                turn.pop()
                continue
            turn[-1] += 1
            child = children[k][c]
            if not left[child]:
                left[child], above[child] = clock, left[k]
                clock += 1
                path.append(child)
                turn.append(0)
    return left, right, above


def number_rows(trace: np.ndarray, ids: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``number_trace`` for many whole traces at once: rows of trace numbers, which rise, span numbers and parents' numbers (-1: none)."""
    n, wide = len(ids), int(max(ids.max(initial=0), parents.max(initial=0))) + 1
    key = trace.astype(np.int64) * wide + ids
    order = np.argsort(key, kind="stable")
    wanted = trace.astype(np.int64) * wide + parents
    at = np.searchsorted(key[order], wanted, "right") - 1  # of equal ids the last row
    found = (parents >= 0) & (at >= 0) & (key[order][at] == wanted)
    up = np.where(found, order[at], -1)
    up[up == np.arange(n)] = -1
    group = np.where(up >= 0, up, n + trace)  # siblings, and the roots of a trace, in row order
    siblings = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[siblings], np.arange(n))
    ends = np.searchsorted(group[siblings], np.arange(n), "right")
    level, levels, reached = np.flatnonzero(up < 0), [], np.zeros(n, bool)
    while len(level):
        reached[level] = True
        levels.append(level)
        sizes = ends[level] - starts[level]
        level = siblings[np.repeat(starts[level] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    size = np.ones(n, np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, up[level], size[level])
    before = np.cumsum(size[siblings]) - size[siblings]
    first = np.searchsorted(group[siblings], group[siblings])
    prior = np.empty(n, np.int64)
    prior[siblings] = before - before[first]
    left = 1 + 2 * prior
    for level in levels[1:]:
        left[level] += left[up[level]]
    right, above = left + 2 * size - 1, np.where(up >= 0, left[up], -1)
    for t in np.unique(trace[~reached]):  # traces with a cycle of parents
        rows = np.flatnonzero(trace == t)
        left[rows], right[rows], above[rows] = number_trace(ids[rows].tolist(), [p if p >= 0 else None for p in parents[rows].tolist()])
    return left, right, above


#: Rows that are numbered at once, or as many as a trace has.
ROWS = 50_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (trace_id, span_id, parent_span_id) sorted by trace; whole traces are numbered as they end."""

    def numbered(t: pa.Table, trace: np.ndarray) -> pa.RecordBatch:
        both = pa.chunked_array([*t["span_id"].chunks, *t["parent_span_id"].chunks], t.schema.field("span_id").type).combine_chunks().dictionary_encode().indices
        codes = both.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        cols = number_rows(trace, codes[: len(t)], codes[len(t) :])
        return pa.RecordBatch.from_arrays([t["trace_id"].combine_chunks(), t["span_id"].combine_chunks(), *(pa.array(c.astype(np.int32)) for c in cols)], ["trace_id", "span_id", "ns_left", "ns_right", "ns_parent"])

    held: list[pa.RecordBatch] = []
    rows = 0

    def traces(t: pa.Table) -> np.ndarray:
        return t["trace_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            t = pa.Table.from_batches(held)
            trace = traces(t)
            whole = int(np.flatnonzero(trace != trace[-1])[-1]) + 1 if (trace != trace[-1]).any() else 0
            if whole:
                yield numbered(t.slice(0, whole), trace[:whole] - trace[:whole].min())
            held = t.slice(whole).to_batches()
            rows = t.num_rows - whole
    if rows:
        t = pa.Table.from_batches(held)
        trace = traces(t)
        yield numbered(t, trace - trace.min())


def _numbered_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_numbered``, of equal ids in a trace the first row only."""
    for batch in _numbered(batches):
        trace, span = (c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2])
        once = np.unique(trace * (batch.num_rows + 1) + span, return_index=True)[1]
        yield batch if len(once) == batch.num_rows else batch.take(pa.array(np.sort(once)))


def of_traces(spans: DataFrame, touched: DataFrame | None) -> DataFrame:
    """The spans of the traces in ``touched`` (trace_id, each once), or all."""
    return spans if touched is None else spans.join(touched, "trace_id")


def with_nested_sets(spans: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """The spans, of ``touched`` traces only if given, with ns_left, ns_right and ns_parent; those of large tables dealt out by trace.

    Only ids go through Python; a trace is numbered as a whole.  Blocks may be written with these columns, which are then kept.
    """
    if {"ns_left", "ns_right", "ns_parent"} <= set(spans.columns):
        return spans
    t, s = spans.schema["trace_id"].dataType.simpleString(), spans.schema["span_id"].dataType.simpleString()
    tasks = tasks_for(spans)
    ids = spans.select("trace_id", "span_id", F.col("parent_span_id").cast(s).alias("parent_span_id"), "start_ns")
    ids = of_traces(dealt(ids, tasks, "trace_id"), touched)
    ids = (ids if tasks else ids.repartition("trace_id")).sortWithinPartitions("trace_id", "start_ns", "span_id")
    numbered = ids.select("trace_id", "span_id", "parent_span_id").mapInArrow(_numbered_once, f"trace_id {t}, span_id {s}, ns_left int, ns_right int, ns_parent int")
    both = ["trace_id", "span_id"]
    return dealt(dealt(spans, tasks, *both).join(dealt(numbered, tasks, *both), both), tasks, "trace_id")


def with_child_counts(spans: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    inner = of_traces(spans.select("trace_id", "parent_span_id"), touched).filter("parent_span_id is not null")
    counts = inner.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count(F.lit(1)).cast("int").alias("child_count"))
    return spans.join(counts, ["trace_id", "span_id"], "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def with_parents(spans: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``parent``: the parent span's facts, null for roots."""
    facts = F.struct("name", "kind", "status", "service", "duration_ns", "attrs", "nums", "bools", "lists", "resource", "status_message").alias("parent")
    above = of_traces(spans, touched).select("trace_id", F.col("span_id").alias("parent_span_id"), facts)
    return spans.join(above, ["trace_id", "parent_span_id"], "left")


def with_trace_facts(spans: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """root_name, root_service and trace_duration_ns on every span."""
    root = F.min(F.when(F.col("parent_span_id").isNull(), F.struct("start_ns", "name", "service"))).alias("_root")
    lasts = (F.max(F.col("start_ns") + F.col("duration_ns")) - F.min("start_ns")).alias("trace_duration_ns")
    facts = of_traces(spans.select("trace_id", "parent_span_id", "start_ns", "duration_ns", "name", "service"), touched).groupBy("trace_id").agg(root, lasts)
    return spans.join(facts.select("trace_id", "trace_duration_ns", F.col("_root.name").alias("root_name"), F.col("_root.service").alias("root_service")), "trace_id", "left")


def code_name(code: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.coalesce(code, F.lit(0))), F.lit(names[0]))


def duration_text(ns: Column) -> Column:
    """A duration such as 1.5ms or 1m2s."""
    tidy = lambda x, unit: F.concat(F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(unit))
    part = lambda div: tidy(ns.cast("decimal(38,9)") / F.lit(div), {1000: "µs", 1_000_000: "ms"}.get(div, "s"))
    whole = F.call_function("div", ns, F.lit(1_000_000_000))
    hours, minutes = F.call_function("div", whole, F.lit(3600)), F.call_function("div", F.pmod(whole, F.lit(3600)), F.lit(60))
    rest = tidy(F.pmod(ns, F.lit(60_000_000_000)).cast("decimal(38,9)") / F.lit(1_000_000_000), "s")
    long = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), F.concat(minutes.cast("string"), F.lit("m")), rest)
    return F.when(ns == 0, "0s").when(ns < 1000, F.concat(ns.cast("string"), F.lit("ns"))).when(ns < 1_000_000, part(1000)).when(ns < 1_000_000_000, part(1_000_000)).when(ns < 60_000_000_000, part(1_000_000_000)).otherwise(long)
