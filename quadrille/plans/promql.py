"""Time-series queries: parser, and compilation of a whole step grid to one DataFrame plan.

A vector is a DataFrame (name, ls, ts, v): ``ls`` the label set as a sorted array, ``ts`` the evaluation time in ms.
Selectors turn each sample into the steps whose window holds it, so that windows are plain groupings
with map-side partial sums.  Functions of successive samples (rate, changes, resets) use what a sample adds to its
predecessor in the series, less what the first sample of the window adds, so they need no lists of samples either.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import LABELS, NAN, compare, fdiv, flog, fmod, keep, label, labels_of, lit, matches, quantile, real, skip_nan, with_label, without
from ..functions.tasks import TASK_BYTES, dealt, tasks_for
from ..operators import native_histograms as nh
from .lexing import QueryError, Tokens, duration_ms, number, unquote

LOOKBACK, INFO_BY = 300_000, ("instance", "job")
#: Points of a range query at most.
MOST_POINTS = 11_000


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Selector:
    name: str | None
    matchers: tuple = ()  # alternatives of (label, op, value)
    range_ms: int | None = None
    offset: int = 0
    at: object = None
    extend: str | None = None  # anchored or smoothed


@dataclass(frozen=True)
class Subquery:
    expr: object
    range_ms: int
    step: int | None
    offset: int = 0
    at: object = None


@dataclass(frozen=True)
class Call:
    fn: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    op: str
    expr: object
    param: object = None
    by: bool | None = None
    labels: tuple = ()


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool_: bool = False
    on: bool | None = None
    labels: tuple = ()
    group: str | None = None
    include: tuple = ()
    fill: tuple = (None, None)


@dataclass(frozen=True)
class Negate:
    expr: object


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.step + 1


AGGREGATES = {"sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "topk", "bottomk", "count_values", "limitk", "limit_ratio"}
PRECEDENCE = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 6}
COMPARE = {"==", "!=", "<", ">", "<=", ">="}


class Parser:
    def __init__(self, text: str):
        self.t = Tokens(text)

    def parse(self):
        e = self.expr(0)
        self.t.done()
        return e

    def expr(self, least: int):
        t = self.t
        if t.is_("-", "+"):
            sign = t.take()[1]
            left = self.expr(6)
            left = Negate(left) if sign == "-" else left
        else:
            left = self.postfix(self.primary())
        while (op := t.peek()[1]) in PRECEDENCE and t.peek()[0] in ("op", "name") and PRECEDENCE[op] >= least:
            t.take()
            mods = self.modifiers()
            right = self.expr(PRECEDENCE[op] + (op != "^"))
            left = Binary(op, left, right, **mods)
        return left

    def names(self) -> tuple:
        t = self.t
        t.expect("(")
        out = []
        while not t.is_(")"):
            out.append(t.take()[1])
            if not t.accept(","):
                break
        t.expect(")")
        return tuple(out)

    def modifiers(self) -> dict:
        t, out = self.t, {}
        if t.accept("bool"):
            out["bool_"] = True
        if t.is_("on", "ignoring"):
            out["on"] = t.take()[1] == "on"
            out["labels"] = self.names()
        if t.is_("group_left", "group_right"):
            out["group"] = t.take()[1][6:]
            out["include"] = self.names() if t.is_("(") else ()
        fill = [None, None]
        while t.is_("fill", "fill_left", "fill_right"):
            which = t.take()[1]
            t.expect("(")
            sign = -1 if t.accept("-") else 1
            value = sign * number(t.kind("number"))
            t.expect(")")
            for k, side in enumerate(("fill_left", "fill_right")):
                if which in ("fill", side):
                    fill[k] = value
        if fill != [None, None]:
            out["fill"] = tuple(fill)
        return out

    def matchers(self) -> tuple:
        t = self.t
        t.expect("{")
        groups, one = [], []
        while not t.is_("}"):
            kind, text = t.take()
            name = unquote(text) if kind == "string" else text
            if kind == "string" and t.is_(",", "}"):
                one.append(("__name__", "=", name))
            else:
                one.append((name, t.expect("=", "!=", "=~", "!~"), unquote(t.kind("string"))))
            if t.accept("or"):
                groups.append(tuple(one))
                one = []
            elif not t.accept(","):
                break
        t.expect("}")
        return (*groups, tuple(one))

    def arguments(self) -> list:
        t = self.t
        t.expect("(")
        out = []
        while not t.is_(")"):
            out.append(self.expr(0))
            if not t.accept(","):
                break
        t.expect(")")
        return out

    def primary(self):
        t = self.t
        kind, text = t.peek()
        if kind == "number":
            t.take()
            return Num(number(text))
        if kind == "duration":
            t.take()
            return Num(duration_ms(text) / 1000)
        if kind == "string":
            t.take()
            return Str(unquote(text))
        if t.accept("("):
            e = self.expr(0)
            t.expect(")")
            return e
        if t.is_("{"):
            return Selector(None, self.matchers())
        if kind != "name":
            raise QueryError(f"unexpected {text!r} in {t.text!r}")
        t.take()
        if text in AGGREGATES and t.is_("(", "by", "without"):
            by, labels = None, ()
            if t.is_("by", "without"):
                by, labels = t.take()[1] == "by", self.names()
            args = self.arguments()
            if by is None and t.is_("by", "without"):
                by, labels = t.take()[1] == "by", self.names()
            return Aggregate(text, args[-1], args[0] if len(args) > 1 else None, by, labels)
        if text.lower() in ("inf", "nan") and not t.is_("{", "("):
            return Num(float(text))
        if t.is_("("):
            return Call(text, tuple(self.arguments()))
        return Selector(text, self.matchers() if t.is_("{") else ())

    def length(self) -> int:
        """A duration, or arithmetic of durations and numbers of seconds."""
        def of(e) -> float:
            if isinstance(e, Num):
                return e.value
            if isinstance(e, Negate):
                return -of(e.expr)
            if isinstance(e, Binary):
                a, b = of(e.left), of(e.right)
                return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else NAN, "%": math.fmod(a, b) if b else NAN, "^": a**b}[e.op]
            raise QueryError("a duration is expected")
        return round(of(self.expr(4)) * 1000)

    def postfix(self, e):
        t = self.t
        while True:
            if t.accept("["):
                size = self.length()
                if t.accept(":"):
                    step = None if t.is_("]") else self.length()
                    e = Subquery(e, size, step)
                else:
                    if not isinstance(e, Selector):
                        raise QueryError("ranges belong to selectors")
                    e = replace(e, range_ms=size)
                t.expect("]")
            elif t.accept("offset"):
                sign = -1 if t.accept("-") else 1
                kind, text = t.peek()
                if kind == "op" and text == "(":
                    value = self.length()
                else:
                    t.take()
                    value = round(duration_ms(text) if kind == "duration" else number(text) * 1000)
                e = replace(e, offset=sign * value)
            elif t.is_("anchored", "smoothed") and isinstance(e, Selector):
                e = replace(e, extend=t.take()[1])
            elif t.accept("@"):
                if t.is_("start", "end"):
                    at = t.take()[1]
                    t.expect("(")
                    t.expect(")")
                else:
                    sign = -1 if t.accept("-") else 1
                    at = round(sign * number(t.kind("number")) * 1000)
                e = replace(e, at=at)
            else:
                return e


def parse(text: str):
    return Parser(text).parse()


def _duration(ms: float) -> str:
    """1h30m for 5,400,000."""
    sign, ms, out = ("-" if ms < 0 else ""), abs(round(ms)), ""
    for unit, size in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1)):
        n, ms = divmod(ms, size)
        out += f"{n}{unit}" if n else ""
    return sign + (out or "0s")


def _number(x: float) -> str:
    if math.isinf(x) or x != x:
        return "NaN" if x != x else "+Inf" if x > 0 else "-Inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'


def format_query(node, width: int = 100, depth: int = 0) -> str:
    """A query in its canonical form; what is longer than ``width`` is split over lines, indented by two spaces a level."""
    pad = "  " * depth
    flat = _flat(node)
    if len(pad) + len(flat) <= width:
        return pad + flat
    inner = lambda x: format_query(x, width, depth + 1)
    if isinstance(node, Aggregate):
        args = ([node.param] if node.param is not None else []) + [node.expr]
        return f"{pad}{node.op}{_grouping(node)} (\n" + ",\n".join(map(inner, args)) + f"\n{pad})"
    if isinstance(node, Call) and node.args:
        return f"{pad}{node.fn}(\n" + ",\n".join(map(inner, node.args)) + f"\n{pad})"
    if isinstance(node, Binary):
        side = lambda x, closed: f"{pad}  (\n{format_query(x, width, depth + 2)}\n{pad}  )" if closed else inner(x)
        one, two = _closed(node)
        return f"{side(node.left, one)}\n{pad}{_operator(node)}\n{side(node.right, two)}"
    return pad + flat


def _closed(node: Binary) -> tuple[bool, bool]:
    """Whether the sides of an operation need parentheses."""
    level, right = PRECEDENCE[node.op], node.op == "^"
    below = lambda x, least: isinstance(x, Binary) and PRECEDENCE[x.op] < least
    return below(node.left, level + right) or isinstance(node.left, Negate) and right, below(node.right, level + (not right))


def _grouping(node: Aggregate) -> str:
    return "" if node.by is None else f" {'by' if node.by else 'without'} ({', '.join(node.labels)})"


def _operator(node: Binary) -> str:
    out = node.op + (" bool" if node.bool_ else "")
    if node.on is not None:
        out += f" {'on' if node.on else 'ignoring'} ({', '.join(node.labels)})"
    if node.group:
        out += f" group_{node.group} ({', '.join(node.include)})" if node.include else f" group_{node.group}"
    left, right = node.fill
    if left is not None and left == right:
        return f"{out} fill({_number(left)})"
    return out + "".join(f" fill_{side}({_number(x)})" for side, x in (("left", left), ("right", right)) if x is not None)


def _place(node) -> str:
    at = "" if node.at is None else f" @ {node.at}()" if isinstance(node.at, str) else f" @ {node.at / 1000:.3f}"
    return (f" {node.extend}" if getattr(node, "extend", None) else "") + (f" offset {_duration(node.offset)}" if node.offset else "") + at


def _flat(node) -> str:
    if isinstance(node, Num):
        return _number(node.value)
    if isinstance(node, Str):
        return _quoted(node.value)
    if isinstance(node, Selector):
        groups = [", ".join(f"{k if re.fullmatch(r'[A-Za-z_][A-Za-z0-9_]*', k) else _quoted(k)}{op}{_quoted(v)}" for k, op, v in g) for g in node.matchers if g]
        braces = "{" + " or ".join(groups) + "}" if groups or not node.name else ""
        return (node.name or "") + braces + (f"[{_duration(node.range_ms)}]" if node.range_ms else "") + _place(node)
    if isinstance(node, Subquery):
        inner = _flat(node.expr)
        return (f"({inner})" if isinstance(node.expr, (Binary, Negate)) else inner) + f"[{_duration(node.range_ms)}:{_duration(node.step) if node.step else ''}]" + _place(node)
    if isinstance(node, Call):
        return f"{node.fn}({', '.join(map(_flat, node.args))})"
    if isinstance(node, Aggregate):
        args = ([node.param] if node.param is not None else []) + [node.expr]
        return f"{node.op}{_grouping(node)} ({', '.join(map(_flat, args))})" if node.by is not None else f"{node.op}({', '.join(map(_flat, args))})"
    if isinstance(node, Negate):
        return "-" + (f"({_flat(node.expr)})" if isinstance(node.expr, Binary) and PRECEDENCE[node.expr.op] < 6 else _flat(node.expr))
    one, two = (f"({_flat(x)})" if closed else _flat(x) for x, closed in zip((node.left, node.right), _closed(node), strict=True))
    return f"{one} {_operator(node)} {two}"


def tree_of(node) -> dict:
    """A parsed query as plain dictionaries."""
    plain = lambda x: tree_of(x) if hasattr(x, "__dataclass_fields__") else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x
    return {"type": type(node).__name__.lower()} | {f: plain(getattr(node, f)) for f in node.__dataclass_fields__}


@dataclass
class Scalar:
    """A number by evaluation time: an expression of ``ts``, or a DataFrame (ts, v) with a row for each step that has one."""

    value: Column | None = None
    df: DataFrame | None = None


@dataclass
class Vector:
    df: DataFrame
    order: list = field(default_factory=list)


#: The columns of a native histogram.
HISTOGRAM = ("schema", "zero_threshold", "zero_count", "count", "sum", "pos", "neg", "custom")


@dataclass
class Store:
    """Samples (name, labels map, ts ms, v, and is_stale if there), in any layout; blocks and recent data may be united.

    A column ``start_ts`` says since when (ms, 0 or null: unknown) a counter has been counting; a start after the sample before is a reset.

    ``ranged`` gives those of low < ts <= high, or more, where a table can leave out what lies outside: by its time column or partitions.
    """

    samples: DataFrame
    ranged: Callable[[int, int], DataFrame] | None = None
    #: Native histograms (name, labels map, ts ms, and the columns HISTOGRAM), if there are any.
    histograms: DataFrame | None = None

    def between(self, low: int, high: int) -> DataFrame:
        return self.ranged(low, high) if self.ranged else self.samples

    @property
    def spark(self) -> SparkSession:
        return self.samples.sparkSession


def floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def to_steps(df: DataFrame, grid: Grid, width: int) -> DataFrame:
    """A row for each step s of the grid with s - width < ts <= s; ``ts`` stays, ``s`` is added."""
    first = F.greatest(F.lit(0).cast("long"), -floor_div(F.lit(grid.start) - F.col("ts"), grid.step))
    last = F.least(F.lit(grid.n - 1).cast("long"), floor_div(F.col("ts") + (width - 1 - grid.start), grid.step))
    inside = df.filter((F.col("ts") > grid.start - width) & (F.col("ts") <= grid.end)).withColumns({"k0": first, "k1": last}).filter("k0 <= k1")
    return inside.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("s", F.col("k") * grid.step + grid.start).drop("k", "k0", "k1")


def restarted(df: DataFrame) -> Column:
    """Whether a sample's start lies after the sample before, or on it where that one had begun earlier."""
    if "st" not in df.columns:
        return F.lit(False)
    c = F.col
    return (c("st") != 0) & (c("st") < c("ts")) & ((c("st") > c("pts")) | ((c("st") == c("pts")) & (c("pst") != 0) & (c("pst") < c("pts"))))


#: Windows of so many units or more are put together from dyadic blocks.
DYADIC = 8
#: A series of so many units or fewer may be one task's work.
SERIES_UNITS = 100_000
#: How partial results of parts of a window are merged, by name; t0 and t1 are the times of the first and the last sample.
MERGES = {
    "n": F.sum, "x_sum": F.sum, "rr": F.sum, "t0": F.min, "t1": F.max, "x_min": lambda c: skip_nan(F.min, F.col(c)), "x_max": lambda c: skip_nan(F.max, F.col(c)), "one": F.max, "p": F.max,
    "v0": lambda c: F.min_by(c, "t0"), "r0": lambda c: F.min_by(c, "t0"), "v1": lambda c: F.max_by(c, "t1"),
}


def over_windows(df: DataFrame, grid: Grid, width: int, keys: list[str], aggs: dict[str, Column], tasks: int = 0) -> DataFrame:
    """(keys, s, aggregates) of the windows (s - width, s] of the grid that hold rows of ``df`` (keys, ts, …).

    Rows of short windows are copied to the steps whose windows hold them.  For long ones, rows are summed into units, the greatest
    common divisor of step and width, and these into blocks of 1, 2, 4, … units; each window is the disjoint union of a few
    blocks, so that a unit makes 2 log2(width / unit) rows instead of width / unit.  Given ``tasks``, units are dealt
    out to so many by keys, where a series has a bounded number of them; blocks and windows then need no further exchange.
    """
    unit = math.gcd(width, grid.step)
    m, q = width // unit, grid.step // unit
    if m < DYADIC or not set(aggs) <= set(MERGES):
        return to_steps(df, grid, width).groupBy(*keys, "s").agg(*[a.alias(k) for k, a in aggs.items()])
    merge = [MERGES[k](k).alias(k) for k in aggs]
    base, top = grid.start - width, m.bit_length() - 1
    inside = df.filter((F.col("ts") > base) & (F.col("ts") <= grid.end))
    units = inside.withColumn("u", floor_div(F.col("ts") - (base + 1), unit)).groupBy(*keys, "u").agg(*[a.alias(k) for k, a in aggs.items()])
    if m + (grid.n - 1) * q <= SERIES_UNITS:
        units = dealt(units, tasks, *keys)
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("l"), F.lit(1 << k).cast("long").alias("w")) for k in range(top + 1)]))
    blocks = units.withColumn("_b", levels).withColumns({"l": F.col("_b.l"), "w": F.col("_b.w")}).withColumn("b", F.call_function("div", "u", "w")).groupBy(*keys, "l", "w", "b").agg(*merge)
    # a window that starts at unit a takes a block if it holds it and does not hold the block of twice the size around it
    p, w, last = F.col("b") * F.col("w"), F.col("w"), F.col("l") == top
    low = F.when(last | (F.pmod("b", F.lit(2)) == 0), p + w - m).otherwise(p - w + 1)
    high = F.when(last | (F.pmod("b", F.lit(2)) == 1), p).otherwise(p + 2 * w - m - 1)
    first, end = F.greatest(F.lit(0).cast("long"), -floor_div(-low, q)), F.least(F.lit(grid.n - 1).cast("long"), floor_div(high, q))
    taken = blocks.withColumns({"k0": first, "k1": end}).filter("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1")))
    return taken.withColumn("s", F.col("k") * grid.step + grid.start).groupBy(*keys, "s").agg(*merge)


# what each function of a range needs of a window: aggregates of v, ts, s and of a sample against its predecessor (pv, pts)
def _extrapolated(kind: str, width: int) -> tuple[dict, Column]:
    counter = kind != "delta"
    reset = F.when(F.col("fell"), F.col("pv")).otherwise(lit(0)) if counter else lit(0)
    aggs = {"n": F.count(F.lit(1)), "t0": F.min("ts"), "t1": F.max("ts"), "v0": F.min_by("v", "ts"), "v1": F.max_by("v", "ts"), "rr": F.sum(reset), "r0": F.min_by(reset, F.col("ts"))}
    delta = F.col("v1") - F.col("v0") + (F.col("rr") - F.col("r0"))
    sampled = (F.col("t1") - F.col("t0")) / 1000.0
    average = sampled / F.greatest(F.col("n") - 1, F.lit(1))
    edge = lambda gap: F.when(gap >= average * 1.1, average / 2).otherwise(gap)
    start = edge((F.col("t0") - F.col("s") + width) / 1000.0)
    if counter:
        zero = sampled * F.col("v0") / F.when(delta > 0, delta).otherwise(lit(1))
        start = F.when((delta > 0) & (F.col("v0") >= 0) & (zero < start), zero).otherwise(start)
    end = edge((F.col("s") - F.col("t1")) / 1000.0)
    out = delta * ((sampled + start + end) / F.when(sampled > 0, sampled).otherwise(lit(1)))
    return aggs, F.when((F.col("n") >= 2) & (sampled > 0), out / (width / 1000.0) if kind == "rate" else out)


def range_function(fn: str, width: int, params: list[float]) -> tuple[dict, Column, bool]:
    """(aggregates, result, whether the predecessor is needed) of a function over windows of ``width`` ms."""
    c = F.col
    if fn in ("rate", "increase", "delta"):
        return (*_extrapolated(fn, width), fn != "delta")
    if fn in ("irate", "idelta"):
        inside = c("p.pts").isNotNull() & (c("p.pts") > c("s") - width)
        d = c("v1") - c("p.pv")
        if fn == "irate":
            d = F.when(c("p.fell"), c("v1")).otherwise(d) / ((c("p.ts") - c("p.pts")) / 1000.0)
        return {"p": F.max(F.struct("ts", "pts", "pv", "fell")), "t1": F.max("ts"), "v1": F.max_by("v", "ts")}, F.when(inside, d), True
    if fn in ("changes", "resets"):
        moved = c("fell") if fn == "resets" else ~((c("v") == c("pv")) | (F.isnan("v") & F.isnan("pv")))
        flag = F.when(c("pv").isNotNull() & moved, lit(1)).otherwise(lit(0))
        return {"rr": F.sum(flag), "r0": F.min_by(flag, "ts"), "t0": F.min("ts")}, c("rr") - c("r0"), True
    if fn in ("deriv", "predict_linear"):
        x = (c("ts") - c("s")) / 1000.0
        aggs = {"n": F.count(F.lit(1)), "a": F.regr_slope("v", x), "b": F.regr_intercept("v", x)}
        return aggs, F.when(c("n") >= 2, c("a") if fn == "deriv" else c("b") + c("a") * params[0]), False
    if fn in ("double_exponential_smoothing", "holt_winters"):
        sf, tf = params
        w = F.sort_array(F.collect_list(F.struct("ts", "v")))
        vs = F.transform(c("w"), lambda e: e["v"])
        v0, v1 = F.get(vs, 0), F.get(vs, 1)
        step = lambda a, v: F.struct(
            (sf * v + (1 - sf) * (a["s1"] + a["b"])).alias("s1"), (tf * ((sf * v + (1 - sf) * (a["s1"] + a["b"])) - a["s1"]) + (1 - tf) * a["b"]).alias("b")
        )
        smooth = F.aggregate(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0))), F.struct(v0.alias("s1"), (v1 - v0).alias("b")), step, lambda a: a["s1"])
        return {"w": w}, F.when(F.size("w") >= 2, smooth), False
    if fn == "mad_over_time":
        w = F.collect_list("v")
        return {"w": w, "m": F.percentile("v", F.lit(0.5))}, F.expr("aggregate(transform(slice(array_sort(transform(w, x -> abs(x - m))), cast((size(w) - 1) div 2 + 1 as int), cast(2 - size(w) % 2 as int)), x -> x / (2 - size(w) % 2)), 0D, (a, x) -> a + x)"), False
    parts: dict[str, tuple[dict, Column]] = {
        "sum_over_time": ({"x_sum": F.sum("v")}, c("x_sum")), "avg_over_time": ({"x_sum": F.sum("v"), "n": F.count(F.lit(1))}, c("x_sum") / c("n")), "count_over_time": ({"n": F.count(F.lit(1))}, c("n").cast("double")),
        "min_over_time": ({"x_min": skip_nan(F.min, c("v"))}, c("x_min")), "max_over_time": ({"x_max": skip_nan(F.max, c("v"))}, c("x_max")),
        "first_over_time": ({"t0": F.min("ts"), "v0": F.min_by("v", "ts")}, c("v0")), "last_over_time": ({"t1": F.max("ts"), "v1": F.max_by("v", "ts")}, c("v1")), "present_over_time": ({"one": F.max(lit(1))}, c("one")),
        "ts_of_first_over_time": ({"t0": F.min("ts")}, c("t0") / 1000.0), "ts_of_last_over_time": ({"t1": F.max("ts")}, c("t1") / 1000.0),
    }
    if fn in parts:
        return (*parts[fn], False)
    simple = {
        "stddev_over_time": lambda: F.stddev_pop("v"), "stdvar_over_time": lambda: F.var_pop("v"), "quantile_over_time": lambda: quantile(params[0], c("v")),
        "ts_of_max_over_time": lambda: F.max(F.struct(F.coalesce(real(c("v")), lit(-math.inf)), "ts"))["ts"] / 1000.0,
        "ts_of_min_over_time": lambda: F.max_by("ts", F.struct(-F.coalesce(real(c("v")), lit(math.inf)), "ts")) / 1000.0,
    }
    if fn not in simple:
        raise QueryError(f"no function {fn}")
    return {"x": simple[fn]()}, c("x"), False


def beyond_long(x: Column) -> Column:
    """Infinities, NaN, and numbers so large that they are whole: ceil, floor and round leave them as they are."""
    return F.isnan(x) | (F.abs(x) >= 2.0**53)


def nearest(v: Column, inverse: float) -> Column:
    x = v * inverse
    return F.when(beyond_long(x), v).otherwise(F.floor(F.when(beyond_long(x), lit(0)).otherwise(x) + 0.5).cast("double") / inverse)


def plain_text(v: Column) -> Column:
    """A number without an exponent, as short as it can be told from others."""
    digits = v.cast("string").try_cast("decimal(38,20)").cast("string")
    short = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(F.isnan(v), "NaN").when(v == math.inf, "+Inf").when(v == -math.inf, "-Inf")
        .when(F.abs(v) >= 2.0**53, F.format_string("%.0f", v)).otherwise(F.coalesce(short, v.cast("string")))
    )


def natural(x: Column) -> Column:
    """A sort key in which runs of digits compare as numbers; a digit stands for them against other signs."""
    chunks = F.regexp_extract_all(x, F.lit(r"\d+|\D+"), 0)
    return F.transform(chunks, lambda t: F.struct(F.when(t.try_cast("long").isNotNull() & t.rlike(r"^\d"), "0").otherwise(t).alias("t"), F.when(t.rlike(r"^\d"), t.try_cast("long")).alias("n")))


RANGE_PARAMS = {"quantile_over_time": (0, 1), "predict_linear": (1, 0), "double_exponential_smoothing": (1, 0), "holt_winters": (1, 0)}
KEEPS_NAME = {"first_over_time", "last_over_time"}
MATH = {
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "sqrt": F.sqrt, "exp": F.exp, "ln": flog,
    "log2": lambda x: flog(x, "2"), "log10": lambda x: flog(x, "10"), "sgn": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos,
    "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians,
}
CALENDAR = {
    "year": F.year, "month": F.month, "day_of_month": F.dayofmonth, "day_of_week": lambda t: F.dayofweek(t) - 1, "day_of_year": F.dayofyear,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)), "hour": F.hour, "minute": F.minute,
}
RANGE = re.compile(r"_over_time$|^(rate|increase|delta|irate|idelta|changes|resets|deriv|predict_linear|double_exponential_smoothing|holt_winters)$")


class Compiler:
    def __init__(self, store: Store, grid: Grid, lookback: int = LOOKBACK, info_by: tuple = INFO_BY):
        self.store, self.spark, self.top, self.lookback, self.info_by = store, store.spark, grid, lookback, info_by

    # --- leaves
    def steps(self, grid: Grid) -> DataFrame:
        return self.spark.range(grid.start, grid.end + 1, grid.step).select(F.col("id").alias("ts"))

    def scan(self, sel: Selector, low: int, high: int, histograms: bool = False) -> DataFrame:
        """Samples, or native histograms, of a selector with low < ts <= high, before its offset is applied."""
        df = self.store.histograms if histograms else self.store.between(low, high)
        stale = F.col("is_stale") if "is_stale" in df.columns else F.lit(False)
        where = (F.col("ts") > low) & (F.col("ts") <= high)
        if sel.name:
            where &= F.col("name") == sel.name
        value = lambda k: F.col("name") if k == "__name__" else F.col("labels")[k]
        groups = [g for g in sel.matchers if g]
        if not sel.name and not any(op in ("=", "=~") and not re.fullmatch(v if op == "=~" else re.escape(v), "") or op in ("!=", "!~") and re.fullmatch(v if op == "!~" else re.escape(v), "") for g in groups for _, op, v in g):
            raise QueryError("a selector needs a matcher that does not match the empty string")
        if groups:
            test = None
            for g in groups:
                one = F.lit(True)
                for k, op, v in g:
                    one &= matches(value(k), op, v)
                test = one if test is None else test | one
            where &= test
        started = [F.coalesce("start_ts", F.lit(0)).cast("long").alias("st")] if not histograms and "start_ts" in df.columns else []
        return df.filter(where).select("name", labels_of(F.col("labels")).alias("ls"), "ts", *(HISTOGRAM if histograms else ["v"]), *started, stale.alias("stale"))

    def pin(self, node, grid: Grid) -> int | None:
        at = node.at
        return {"start": self.top.start, "end": self.top.end}.get(at, at)

    def spread(self, df: DataFrame, grid: Grid) -> DataFrame:
        """Values at one time, repeated for all steps."""
        return df.drop("ts").withColumn("ts", F.explode(F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.step)))).select("name", "ls", "ts", "v")

    def instant(self, sel: Selector, grid: Grid) -> DataFrame:
        if sel.at is not None:
            t = self.pin(sel, grid)
            return self.spread(self.instant(replace(sel, at=None), Grid(t, t, 1)), grid)
        df = self.scan(sel, grid.start - sel.offset - self.lookback, grid.end - sel.offset).withColumn("ts", F.col("ts") + sel.offset)
        last = to_steps(df, grid, self.lookback).groupBy("name", "ls", "s").agg(F.max_by(F.struct("v", "stale"), "ts").alias("x"))
        return last.filter("not x.stale").select("name", "ls", F.col("s").alias("ts"), "x.v")

    def windows(self, node, grid: Grid) -> tuple[DataFrame, int]:
        """Samples (name, ls, ts, v) that windows ending on the grid can hold, with the offset applied, and the windows' width."""
        if isinstance(node, Selector) and node.range_ms:
            df = self.scan(node, grid.start - node.offset - node.range_ms, grid.end - node.offset).filter("not stale").drop("stale")
        elif isinstance(node, Subquery):
            step = node.step or grid.step
            first = (grid.start - node.offset - node.range_ms) // step * step + step
            inner = Grid(first, (grid.end - node.offset) // step * step, step)
            if inner.n < 1:
                inner = Grid(first, first, step)
            df = self.vector(node.expr, inner)
        else:
            raise QueryError("a range is expected")
        if "st" in df.columns:
            df = df.withColumn("st", F.when(F.col("st") != 0, F.col("st") + node.offset).otherwise(0))
        return df.withColumn("ts", F.col("ts") + node.offset), node.range_ms

    def over_time(self, fn: str, node, params: list[float], grid: Grid) -> DataFrame:
        if getattr(node, "at", None) is not None:
            t = self.pin(node, grid)
            return self.spread(self.over_time(fn, replace(node, at=None), params, Grid(t, t, 1)), grid)
        if getattr(node, "extend", None):
            return self.extended(fn, node, grid)
        df, width = self.windows(node, grid)
        aggs, result, pairs = range_function(fn, width, params)
        tasks = tasks_for(df, TASK_BYTES // 2)  # a sample makes several rows of blocks and windows
        if pairs:
            df = dealt(df, tasks, "name", "ls")
            w = Window.partitionBy("name", "ls").orderBy("ts")
            df = df.withColumns({"pv": F.lag("v").over(w), "pts": F.lag("ts").over(w)} | ({"pst": F.lag("st").over(w)} if "st" in df.columns else {}))
            df = df.withColumn("fell", F.coalesce((F.col("v") < F.col("pv")) | restarted(df), F.lit(False)))
        out = over_windows(df, grid, width, ["name", "ls"], aggs, 0 if pairs else tasks)
        name = F.col("name") if fn in KEEPS_NAME else F.lit(None).cast("string")
        return out.select(name.alias("name"), "ls", F.col("s").alias("ts"), result.alias("v")).filter("v is not null")

    def extended(self, fn: str, node: Selector, grid: Grid) -> DataFrame:
        """Ranges that reach to the sample before them (anchored), or whose ends are interpolated with the samples around them (smoothed).

        A sample knows the one before and the one after it, so that a window needs no others; windows between two
        samples are made from the earlier of them.
        """
        smooth, counter = node.extend == "smoothed", fn in ("rate", "increase")
        if fn not in (("rate", "increase", "delta") if smooth else ("rate", "increase", "delta", "changes", "resets")):
            raise QueryError(f"{fn} takes no {node.extend} range")
        width, around = node.range_ms, self.lookback
        df = self.scan(node, grid.start - node.offset - width - around, grid.end - node.offset + (around if smooth else 0)).filter("not stale").drop("stale").withColumn("ts", F.col("ts") + node.offset)
        w = Window.partitionBy("name", "ls").orderBy("ts")
        df = df.withColumns({"pv": F.lag("v").over(w), "pts": F.lag("ts").over(w), "nv": F.lead("v").over(w), "nts": F.lead("ts").over(w)})
        c = F.col
        start = c("s") - width
        fell = F.when(c("v") < c("pv"), c("pv")).otherwise(lit(0))
        moved = c("v") < c("pv") if fn == "resets" else ~((c("v") == c("pv")) | (F.isnan("v") & F.isnan("pv")))
        step = F.when(c("pv").isNotNull() & moved, lit(1)).otherwise(lit(0)) if fn in ("changes", "resets") else fell
        ends = F.min(F.struct("ts", "v", "pts", "pv", step.alias("r"))).alias("a"), F.max(F.struct("ts", "v", "nts", "nv")).alias("z")
        got = to_steps(df, grid, width).groupBy("name", "ls", "s").agg(*ends, F.sum(step).alias("r"))
        anchor = c("a.pts").isNotNull() & (c("a.pts") > start - around)
        if fn in ("changes", "resets"):
            value = F.when(anchor, c("r")).otherwise(c("r") - c("a.r"))
        elif not smooth:
            left = F.when(anchor, c("a.pv")).otherwise(c("a.v"))
            value = c("z.v") - left + (F.when(anchor, c("r")).otherwise(c("r") - c("a.r")) if counter else lit(0))
        else:
            between = lambda x0, y0, x1, y1, at: (y := F.when(y1 < y0, lit(0)).otherwise(y0) if counter else y0) + (y1 - y) * (at - x0) / (x1 - x0)
            left = F.when(anchor & (c("a.pts") == start), c("a.pv")).when(anchor, between(c("a.pts"), c("a.pv"), c("a.ts"), c("a.v"), start)).otherwise(c("a.v"))
            after = c("z.nts").isNotNull() & (c("z.nts") <= c("s") + around) & (c("z.ts") < c("s"))
            right = F.when(after, between(c("z.ts"), c("z.v"), c("z.nts"), c("z.nv"), c("s"))).otherwise(c("z.v"))
            last = F.when(after & (c("z.nv") < c("z.v")), c("z.v")).otherwise(lit(0))
            first = F.when(anchor & (c("a.pts") == start), lit(0)).otherwise(c("a.r"))
            value = right - left + (c("r") - first + last if counter else lit(0))
        out = got.select("name", "ls", "s", value.alias("v"))
        if smooth:
            first = F.greatest(F.lit(0).cast("long"), -floor_div(F.lit(grid.start) - (c("ts") + width), grid.step))
            end = F.least(F.lit(grid.n - 1).cast("long"), floor_div(c("nts") - 1 - grid.start, grid.step))
            gaps = df.filter("nts is not null").withColumns({"k0": first, "k1": end}).filter("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("s", c("k") * grid.step + grid.start)
            gaps = gaps.filter((c("ts") > start - around) & (c("nts") <= c("s") + around))
            base = F.when(c("nv") < c("v"), lit(0)).otherwise(c("v")) if counter else c("v")
            out = out.unionByName(gaps.select("name", "ls", "s", ((c("nv") - base) * width / (c("nts") - c("ts"))).alias("v")))
        value = c("v") / (width / 1000.0) if fn == "rate" else c("v")
        return out.select(F.lit(None).cast("string").alias("name"), "ls", c("s").alias("ts"), value.alias("v"))

    # --- expressions
    def constant(self, node) -> float:
        if isinstance(node, Num):
            return node.value
        if isinstance(node, Negate):
            return -self.constant(node.expr)
        if isinstance(node, Call) and node.fn == "pi":
            return math.pi
        if isinstance(node, Call) and node.fn in ("start", "end", "step", "range") and not node.args:
            g = self.top
            return {"start": g.start, "end": g.end, "step": g.step, "range": g.end - g.start}[node.fn] / 1000
        if isinstance(node, Binary):
            a, b = self.constant(node.left), self.constant(node.right)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b, "%": lambda: math.fmod(a, b)}[node.op]()
        raise QueryError("a constant is expected")

    def is_scalar(self, node) -> bool:
        if isinstance(node, Num):
            return True
        if isinstance(node, Negate):
            return self.is_scalar(node.expr)
        if isinstance(node, Binary):
            return self.is_scalar(node.left) and self.is_scalar(node.right)
        return isinstance(node, Call) and node.fn in ("time", "scalar", "pi", "start", "end", "step", "range", "min_of", "max_of")

    def scalar(self, node, grid: Grid) -> Scalar:
        if isinstance(node, Num):
            return Scalar(lit(node.value))
        if isinstance(node, Negate):
            s = self.scalar(node.expr, grid)
            return Scalar(-s.value) if s.df is None else Scalar(df=s.df.withColumn("v", -F.col("v")))
        if isinstance(node, Binary):
            a, b = self.scalar(node.left, grid), self.scalar(node.right, grid)
            if a.df is None and b.df is None:
                return Scalar(self.arithmetic(node.op, a.value, b.value))
            x, y = (s.df if s.df is not None else self.steps(grid).withColumn("v", s.value) for s in (a, b))
            both = x.join(y.withColumnRenamed("v", "w"), "ts")
            return Scalar(df=both.select("ts", self.arithmetic(node.op, F.col("v"), F.col("w")).alias("v")))
        if node.fn == "time":
            return Scalar(F.col("ts") / 1000.0)
        if node.fn in ("min_of", "max_of"):
            a, b = (self.scalar(x, grid).value for x in node.args)
            return Scalar((F.least if node.fn == "min_of" else F.greatest)(a, b))
        if node.fn == "scalar":
            got = self.vector(node.args[0], grid).groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("x"))
            all_ = self.steps(grid).join(got, "ts", "left")
            return Scalar(df=all_.select("ts", F.when(F.col("n") == 1, F.col("x")).otherwise(lit(NAN)).alias("v")))
        return Scalar(lit(self.constant(node)))

    @staticmethod
    def arithmetic(op: str, a: Column, b: Column) -> Column:
        if op in COMPARE:
            return compare(op, a, b).cast("double")
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: fdiv(a, b), "%": lambda: fmod(a, b), "^": lambda: F.pow(a, b), "atan2": lambda: F.atan2(a, b)}[op]()

    def vector(self, node, grid: Grid) -> DataFrame:
        none = F.lit(None).cast("string")
        if isinstance(node, Selector):
            if node.range_ms:
                raise QueryError("a range has to be given to a function")
            return self.instant(node, grid)
        if isinstance(node, Negate) and not self.is_scalar(node):
            return self.vector(node.expr, grid).withColumns({"v": -F.col("v"), "name": none})
        if isinstance(node, Aggregate):
            return self.aggregate(node, grid)
        if self.is_scalar(node):
            s = self.scalar(node, grid)
            df = s.df if s.df is not None else self.steps(grid).withColumn("v", s.value)
            return df.select(none.alias("name"), F.array().cast(LABELS).alias("ls"), "ts", "v")
        if isinstance(node, Binary):
            return self.binary(node, grid)
        if isinstance(node, Call):
            return self.call(node, grid)
        raise QueryError(f"no vector: {node}")

    def with_scalar(self, df: DataFrame, s: Scalar, name: str) -> DataFrame:
        return df.withColumn(name, s.value) if s.df is None else df.join(s.df.withColumnRenamed("v", name), "ts")

    def binary(self, node: Binary, grid: Grid) -> DataFrame:
        none, op = F.lit(None).cast("string"), node.op
        sides = self.is_scalar(node.left), self.is_scalar(node.right)
        if any(sides):
            df = self.with_scalar(self.vector(node.right if sides[0] else node.left, grid), self.scalar(node.left if sides[0] else node.right, grid), "w")
            a, b = (F.col("w"), F.col("v")) if sides[0] else (F.col("v"), F.col("w"))
            if op in COMPARE and not node.bool_:
                return df.filter(compare(op, a, b)).select("name", "ls", "ts", "v")
            return df.select(none.alias("name"), "ls", "ts", self.arithmetic(op, a, b).alias("v"))
        key = lambda ls: keep(ls, list(node.labels)) if node.on else without(ls, list(node.labels))
        left, right = (self.vector(x, grid).withColumn("key", key(F.col("ls"))) for x in (node.left, node.right))
        cols = ["name", "ls", "ts", "v"]
        keys = right.select("key", "ts").distinct()
        if op == "and":
            return left.join(keys, ["key", "ts"], "left_semi").select(cols)
        if op == "unless":
            return left.join(keys, ["key", "ts"], "left_anti").select(cols)
        if op == "or":
            return left.select(cols).unionByName(right.join(left.select("key", "ts").distinct(), ["key", "ts"], "left_anti").select(cols))

        def once(df: DataFrame, prefix: str) -> DataFrame:
            """One row for a key and time; a second one is an error."""
            got = df.groupBy("key", "ts").agg(F.max(F.struct("name", "ls", "v")).alias("r"), F.count(F.lit(1)).alias("n"))
            v = F.when(F.col("n") > 1, F.raise_error(F.lit("found duplicate series for the match group"))).otherwise(F.col("r.v"))
            return got.select("key", "ts", F.col("r.name").alias(f"{prefix}name"), F.col("r.ls").alias(f"{prefix}ls"), v.cast("double").alias(f"{prefix}v"))

        many = lambda df, prefix: df.select("key", "ts", *[F.col(c).alias(f"{prefix}{c}") for c in ("name", "ls", "v")])
        a = many(left, "a_") if node.group == "left" else once(left, "a_")
        b = many(right, "b_") if node.group == "right" else once(right, "b_")
        how = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "full"}[tuple(f is not None for f in node.fill)]
        j = a.join(b, ["key", "ts"], how)
        x = F.col("a_v") if node.fill[0] is None else F.coalesce("a_v", lit(node.fill[0]))
        y = F.col("b_v") if node.fill[1] is None else F.coalesce("b_v", lit(node.fill[1]))
        if node.group:
            own, other = ("a_", "b_") if node.group == "left" else ("b_", "a_")
            ls = F.coalesce(F.col(f"{own}ls"), F.col(f"{other}ls"))
            for name in node.include:
                ls = with_label(ls, name, F.coalesce(label(F.col(f"{other}ls"), name), F.lit("")))
            name = F.col(f"{own}name")
        else:
            ls, name = F.col("key"), F.coalesce("a_name", "b_name")
        if op in COMPARE and not node.bool_:
            return j.filter(compare(op, x, y)).select(name.alias("name"), ls.alias("ls"), "ts", x.alias("v"))
        return j.select(none.alias("name"), ls.alias("ls"), "ts", self.arithmetic(op, x, y).alias("v"))

    def aggregate(self, node: Aggregate, grid: Grid) -> DataFrame:
        df, none = self.vector(node.expr, grid), F.lit(None).cast("string")
        group = keep(F.col("ls"), list(node.labels)) if node.by else without(F.col("ls"), list(node.labels)) if node.by is False else F.array().cast(LABELS)
        df, op = df.withColumn("g", group), node.op
        if op in ("topk", "bottomk", "limitk", "limit_ratio"):
            h = F.xxhash64("name", "ls")
            if op == "limit_ratio":
                r = self.constant(node.param)
                at = h.cast("double") / 2.0**64 + 0.5
                return df.filter(at < r if r >= 0 else at >= 1 + r).select("name", "ls", "ts", "v")
            nan_last = F.isnan("v").asc()
            order = [h] if op == "limitk" else [nan_last, F.desc("v") if op == "topk" else F.asc("v"), F.asc("ls")]
            k = int(self.constant(node.param))
            ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("g", "ts").orderBy(*order)))
            return ranked.filter(F.col("rank") <= k).select("name", "ls", "ts", "v")
        if op == "count_values":
            counted = df.withColumn("g", with_label(F.col("g"), node.param.value, plain_text(F.col("v"))))
            return counted.groupBy("g", "ts").agg(F.count(F.lit(1)).cast("double").alias("v")).select(none.alias("name"), F.col("g").alias("ls"), "ts", "v")
        value = {
            "sum": lambda: F.sum("v"), "avg": lambda: F.avg("v"), "count": lambda: F.count(F.lit(1)).cast("double"), "group": lambda: F.first(lit(1)),
            "min": lambda: skip_nan(F.min, F.col("v")), "max": lambda: skip_nan(F.max, F.col("v")), "stddev": lambda: F.stddev_pop("v"), "stdvar": lambda: F.var_pop("v"),
            "quantile": lambda: quantile(self.constant(node.param), F.col("v")),
        }[op]()
        return df.groupBy("g", "ts").agg(value.alias("v")).select(none.alias("name"), F.col("g").alias("ls"), "ts", "v")

    def call(self, node: Call, grid: Grid) -> DataFrame:
        fn, args, none = node.fn, node.args, F.lit(None).cast("string")
        if fn in ("absent", "absent_over_time"):
            inner = args[0]
            have = (self.over_time("present_over_time", inner, [], grid) if fn != "absent" else self.vector(inner, grid)).select("ts").distinct()
            equal = {}
            if isinstance(inner, Selector) and inner.matchers:
                names = [k for k, _, _ in inner.matchers[0]]
                equal = {k: v for k, op, v in inner.matchers[0] if op == "=" and names.count(k) == 1 and k != "__name__"}
            ls = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted(equal.items())]) if equal else F.array().cast(LABELS)
            return self.steps(grid).join(have, "ts", "left_anti").select(none.alias("name"), ls.alias("ls"), "ts", lit(1).alias("v"))
        if RANGE.search(fn):
            at = RANGE_PARAMS.get(fn, (None, 0))[1]
            params = [self.constant(a) for k, a in enumerate(args) if k != at]
            return self.over_time(fn, args[at], params, grid)
        if fn == "vector":
            return self.vector(args[0], grid)
        if fn in CALENDAR:
            df = self.vector(args[0] if args else Call("time", ()), grid)
            t = F.expr("timestampadd(SECOND, cast(floor(v) as bigint), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
            return df.select(none.alias("name"), "ls", "ts", CALENDAR[fn](t).cast("double").alias("v"))
        if fn in ("histogram_quantile", "histogram_fraction", "histogram_quantiles"):
            own = self.native_value(fn, args, grid)
            return self.histogram(fn, node, grid) if own is None else self.histogram(fn, node, grid).unionByName(own)
        if fn in ("histogram_count", "histogram_sum", "histogram_avg", "histogram_stddev", "histogram_stdvar"):
            own = self.native_value(fn, args, grid)
            return own if own is not None else self.steps(grid).filter("false").select(none.alias("name"), F.array().cast(LABELS).alias("ls"), "ts", lit(0).alias("v"))
        if fn == "info":
            return self.info(args, grid)
        vectors = [a for a in args if not isinstance(a, Str) and not (self.is_scalar(a))]
        if fn == "timestamp" and isinstance(args[0], Selector):
            sel = args[0]
            df = self.scan(sel, grid.start - sel.offset - self.lookback, grid.end - sel.offset)
            df = to_steps(df.withColumn("ts", F.col("ts") + sel.offset), grid, self.lookback).groupBy("name", "ls", "s").agg(F.max("ts").alias("t"))
            return df.select(none.alias("name"), "ls", F.col("s").alias("ts"), ((F.col("t") - sel.offset) / 1000.0).alias("v"))
        if fn == "start_timestamp":
            sel, nothing = args[0], self.steps(grid).filter("false").select(none.alias("name"), F.array().cast(LABELS).alias("ls"), "ts", lit(0).alias("v"))
            if not isinstance(sel, Selector):  # starts belong to samples only
                return nothing
            df = self.scan(sel, grid.start - sel.offset - self.lookback, grid.end - sel.offset)
            start = F.col("st") if "st" in df.columns else F.lit(0).cast("long")
            df = to_steps(df.withColumn("ts", F.col("ts") + sel.offset), grid, self.lookback).groupBy("name", "ls", "s").agg(F.max_by(F.struct(start.alias("st"), "stale"), "ts").alias("x"))
            return df.filter("not x.stale").select(none.alias("name"), "ls", F.col("s").alias("ts"), (F.col("x.st") / 1000.0).alias("v"))
        df = self.vector(vectors[0] if vectors else args[0], grid)
        v = F.col("v")
        if fn in MATH:
            out = MATH[fn](v)
            if fn in ("ceil", "floor"):
                out = F.when(beyond_long(v), v).otherwise(MATH[fn](F.when(beyond_long(v), lit(0)).otherwise(v)))
            return df.select(none.alias("name"), "ls", "ts", out.alias("v"))
        if fn == "round":
            inverse = 1.0 / (self.constant(args[1]) if len(args) > 1 else 1.0)
            return df.select(none.alias("name"), "ls", "ts", nearest(v, inverse).alias("v"))
        if fn in ("clamp", "clamp_min", "clamp_max"):
            low = self.constant(args[1]) if fn != "clamp_max" else -math.inf
            high = self.constant(args[-1]) if fn != "clamp_min" else math.inf
            if low > high:
                df = df.filter("false")
            return df.select(none.alias("name"), "ls", "ts", F.when(F.isnan(v), v).otherwise(F.greatest(lit(low), F.least(lit(high), v))).alias("v"))
        if fn == "timestamp":
            return df.select(none.alias("name"), "ls", "ts", (F.col("ts") / 1000.0).alias("v"))
        if fn == "label_replace":
            dst, to, src, pattern = (a.value for a in args[1:])
            value = F.coalesce(F.col("name") if src == "__name__" else label(F.col("ls"), src), F.lit(""))
            full = f"^(?s:{pattern})$"
            made = F.regexp_replace(value, full, re.sub(r"\$\{(\d+)\}", r"$\1", to))
            return df.select("name", F.when(value.rlike(full), with_label(F.col("ls"), dst, made)).otherwise(F.col("ls")).alias("ls"), "ts", "v")
        if fn == "label_join":
            dst, sep, *src = (a.value for a in args[1:])
            made = F.array_join(F.array(*[F.coalesce(label(F.col("ls"), s), F.lit("")) for s in src]), sep)
            return df.select("name", with_label(F.col("ls"), dst, made).alias("ls"), "ts", "v")
        if fn in ("sort", "sort_desc"):
            return df.orderBy(F.isnan("v"), F.asc("v") if fn == "sort" else F.desc("v"), "ls")
        if fn in ("sort_by_label", "sort_by_label_desc"):
            by = [natural(F.coalesce(label(F.col("ls"), a.value), F.lit(""))) for a in args[1:]]
            return df.orderBy(*[x.asc() if fn == "sort_by_label" else x.desc() for x in by], "ls")
        raise QueryError(f"no function {fn}")

    def histogram(self, fn: str, node: Call, grid: Grid) -> DataFrame:
        """Classic buckets: one array of (le, count) for each series and step, made monotone."""
        df = self.vector(node.args[-1] if fn != "histogram_quantiles" else node.args[1], grid)
        le = label(F.col("ls"), "le")
        bound = F.when(F.lower(le).isin("+inf", "inf"), lit(math.inf)).otherwise(F.expr("try_cast(le as double)"))
        b = df.withColumn("le", le).filter("le is not null").select(without(F.col("ls"), ["le"]).alias("ls"), "ts", F.struct(bound.alias("le"), F.col("v").alias("c")).alias("b"))
        grouped = b.groupBy("ls", "ts").agg(F.sort_array(F.collect_list("b")).alias("raw"))  # a row for each bucket's bound
        rising = F.expr("transform(raw, (x, k) -> named_struct('le', x.le, 'c', array_max(transform(slice(raw, 1, k + 1), y -> y.c))))")
        g = grouped.withColumn("bs", rising).withColumn("total", F.expr("element_at(bs, -1).c")).filter("isnotnull(element_at(bs, -1).le)")
        none = F.lit(None).cast("string")
        if fn == "histogram_fraction":
            low, high = (self.constant(a) for a in node.args[:2])
            cdf = lambda x: F.expr(
                f"aggregate(transform(bs, (y, k) -> named_struct('lo', if(k = 0, if(y.le > 0, 0D, y.le), bs[k - 1].le), 'hi', y.le, 'below', if(k = 0, 0D, bs[k - 1].c), 'n', y.c - if(k = 0, 0D, bs[k - 1].c))), 0D,"
                f" (a, y) -> a + case when y.hi <= {x!r}D then y.n when y.lo >= {x!r}D or y.hi = double('Infinity') then 0D else y.n * ({x!r}D - y.lo) / (y.hi - y.lo) end)"
            )
            share = (cdf(high) - cdf(low)) / F.when(F.col("total") > 0, F.col("total")).otherwise(lit(1))
            return g.select(none.alias("name"), "ls", "ts", F.when(F.col("total") > 0, share).otherwise(lit(NAN)).alias("v"))

        def at(phi: float) -> Column:
            if phi != phi or phi < 0 or phi > 1:
                return lit(NAN if phi != phi else math.copysign(math.inf, phi if phi > 0 else -1))
            first = f"greatest(1, coalesce(array_position(transform(bs, y -> y.c >= {phi!r}D * total), true), 1))"
            x = F.expr(
                f"""case when isnan(total) or total = 0 or element_at(bs, -1).le <> double('Infinity') or size(bs) < 2 then double('NaN')
                when {first} = size(bs) then bs[size(bs) - 2].le
                when {first} = 1 and bs[0].le <= 0 then bs[0].le
                else if({first} = 1, 0D, get(bs, cast({first} as int) - 2).le) + (get(bs, cast({first} as int) - 1).le - if({first} = 1, 0D, get(bs, cast({first} as int) - 2).le))
                  * ({phi!r}D * total - if({first} = 1, 0D, get(bs, cast({first} as int) - 2).c))
                  / nullif(get(bs, cast({first} as int) - 1).c - if({first} = 1, 0D, get(bs, cast({first} as int) - 2).c), 0D) end"""
            )
            return F.coalesce(x, lit(NAN))

        if fn == "histogram_quantile":
            return g.select(none.alias("name"), "ls", "ts", at(self.constant(node.args[0])).alias("v"))
        phis = [self.constant(a) for a in node.args[2:]]
        each = F.explode(F.array(*[F.struct(F.lit(repr(p)).alias("p"), at(p).alias("v")) for p in phis])).alias("e")
        return g.select("ls", "ts", each).select(none.alias("name"), with_label(F.col("ls"), node.args[0].value, F.col("e.p")).alias("ls"), "ts", "e.v")

    # --- native histograms
    def native(self, node, grid: Grid) -> DataFrame | None:
        """The native histograms (name, ls, ts, HISTOGRAM) of an expression; None where it has none."""
        if self.store.histograms is None:
            return None
        none, keys = F.lit(None).cast("string"), ["name", "ls", "ts"]
        if isinstance(node, Selector) and not node.range_ms:
            if node.at is not None:
                t = self.pin(node, grid)
                one = self.native(replace(node, at=None), Grid(t, t, 1))
                return one.drop("ts").withColumn("ts", F.explode(F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.step)))).select(*keys, *HISTOGRAM)
            df = self.scan(node, grid.start - node.offset - self.lookback, grid.end - node.offset, histograms=True).withColumn("ts", F.col("ts") + node.offset)
            last = to_steps(df, grid, self.lookback).groupBy("name", "ls", "s").agg(F.max_by(F.struct(*HISTOGRAM, "stale"), "ts").alias("x"))
            return last.filter("not x.stale").select("name", "ls", F.col("s").alias("ts"), *[f"x.{c}" for c in HISTOGRAM])
        if isinstance(node, Negate):
            df = self.native(node.expr, grid)
            return None if df is None else nh.scaled(df, -1.0).withColumn("name", none)
        if isinstance(node, Aggregate) and node.op in ("sum", "avg"):
            df = self.native(node.expr, grid)
            if df is None:
                return None
            group = keep(F.col("ls"), list(node.labels)) if node.by else without(F.col("ls"), list(node.labels)) if node.by is False else F.array().cast(LABELS)
            df = df.withColumns({"ls": group, "name": none})
            total = nh.merge(df.drop("name"), ["ls", "ts"])
            if node.op == "avg":
                total = nh.scaled(total.join(df.groupBy("ls", "ts").agg(F.count(F.lit(1)).alias("_k")), ["ls", "ts"]), 1 / F.col("_k")).drop("_k")
            return total.select(none.alias("name"), "ls", "ts", *HISTOGRAM)
        if isinstance(node, Binary) and node.op in ("*", "/", "+", "-"):
            return self.native_binary(node, grid)
        if isinstance(node, Call) and node.fn in ("rate", "increase", "delta", "sum_over_time", "avg_over_time", "last_over_time") and isinstance(node.args[0], Selector):
            return self.native_over_time(node.fn, node.args[0], grid)
        return None

    def native_binary(self, node: Binary, grid: Grid) -> DataFrame | None:
        none = F.lit(None).cast("string")
        sides = self.is_scalar(node.left), self.is_scalar(node.right)
        if any(sides):
            df = self.native(node.right if sides[0] else node.left, grid)
            if df is None or node.op not in ("*", "/") or sides[0] and node.op == "/":
                return None
            joined = self.with_scalar(df, self.scalar(node.left if sides[0] else node.right, grid), "_w")
            factor = F.col("_w") if node.op == "*" else fdiv(lit(1), F.col("_w"))
            return nh.scaled(joined.withColumn("_w", factor), F.col("_w")).select(none.alias("name"), "ls", "ts", *HISTOGRAM)
        left, right = self.native(node.left, grid), self.native(node.right, grid)
        if node.op in ("*", "/"):  # by a float vector
            if left is None:
                return None
            key = lambda df: df.withColumn("key", keep(F.col("ls"), list(node.labels)) if node.on else without(F.col("ls"), list(node.labels)))
            other = key(self.vector(node.right, grid)).select("key", "ts", F.col("v").alias("_w"))
            joined = key(left).join(other, ["key", "ts"])
            return nh.scaled(joined.withColumn("_w", F.col("_w") if node.op == "*" else fdiv(lit(1), F.col("_w"))), F.col("_w")).select(none.alias("name"), F.col("ls" if node.group else "key").alias("ls"), "ts", *HISTOGRAM)
        if left is None or right is None:
            return None
        key = lambda df: df.withColumn("key", keep(F.col("ls"), list(node.labels)) if node.on else without(F.col("ls"), list(node.labels))).drop("name", "ls")
        one, two = key(left).withColumn("_side", F.lit(1)), key(nh.scaled(right, -1.0) if node.op == "-" else right).withColumn("_side", F.lit(2))
        both = one.unionByName(two)
        met = both.groupBy("key", "ts").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_side").alias("_sides")).filter("_sides = 2")
        fail = F.raise_error(F.lit("found duplicate series for the match group")).cast("boolean")
        met = met.filter(F.when(F.col("_n") > 2, fail).otherwise(F.lit(True))).select("key", "ts")
        return nh.merge(both.drop("_side").join(met, ["key", "ts"]), ["key", "ts"]).select(none.alias("name"), F.col("key").alias("ls"), "ts", *HISTOGRAM)

    def native_over_time(self, fn: str, sel: Selector, grid: Grid) -> DataFrame:
        if sel.at is not None:
            t = self.pin(sel, grid)
            one = self.native_over_time(fn, replace(sel, at=None), Grid(t, t, 1))
            return one.drop("ts").withColumn("ts", F.explode(F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.step)))).select("name", "ls", "ts", *HISTOGRAM)
        none, width, keys = F.lit(None).cast("string"), sel.range_ms, ["name", "ls", "s"]
        df = self.scan(sel, grid.start - sel.offset - width, grid.end - sel.offset, histograms=True).filter("not stale").drop("stale").withColumn("ts", F.col("ts") + sel.offset)
        steps = to_steps(df, grid, width)
        if fn == "last_over_time":
            last = steps.groupBy(*keys).agg(F.max_by(F.struct(*HISTOGRAM), "ts").alias("x"))
            return last.select("name", "ls", F.col("s").alias("ts"), *[f"x.{c}" for c in HISTOGRAM])
        facts = to_steps(df.select("name", "ls", "ts", "count"), grid, width).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.min_by("count", "ts").alias("_c0"))
        if fn in ("sum_over_time", "avg_over_time"):
            total = nh.merge(steps.drop("ts"), keys)
            out = total if fn == "sum_over_time" else nh.scaled(total.join(facts.select(*keys, "_n"), keys), 1 / F.col("_n")).drop("_n")
            return out.select(none.alias("name"), "ls", F.col("s").alias("ts"), *HISTOGRAM)
        # what each sample of a window adds to the one before, but for the first
        gained = to_steps(nh.increases(df, ["name", "ls"], counter=fn != "delta"), grid, width).join(facts, keys).filter(F.col("ts") > F.col("_t0"))
        total = nh.merge(gained.select(*keys, *HISTOGRAM), keys).join(facts, keys)
        sampled = (F.col("_t1") - F.col("_t0")) / 1000.0
        average = sampled / F.greatest(F.col("_n") - 1, F.lit(1))
        edge = lambda gap: F.when(gap >= average * 1.1, average / 2).otherwise(gap)
        start, end = edge((F.col("_t0") - F.col("s") + width) / 1000.0), edge((F.col("s") - F.col("_t1")) / 1000.0)
        if fn != "delta":
            zero = sampled * F.col("_c0") / F.when(F.col("count") > 0, F.col("count")).otherwise(lit(1))
            start = F.when((F.col("count") > 0) & (F.col("_c0") >= 0) & (zero < start), zero).otherwise(start)
        factor = (sampled + start + end) / F.when(sampled > 0, sampled).otherwise(lit(1)) / (width / 1000.0 if fn == "rate" else 1.0)
        return nh.scaled(total.withColumn("_f", factor).filter(sampled > 0), F.col("_f")).select(none.alias("name"), "ls", F.col("s").alias("ts"), *HISTOGRAM)

    def native_value(self, fn: str, args: tuple, grid: Grid) -> DataFrame | None:
        """(name, ls, ts, v) of a histogram function of native histograms."""
        keys, none = ["ls", "ts"], F.lit(None).cast("string")
        at = {"histogram_quantiles": 1}.get(fn, len(args) - 1)
        df = self.native(args[at], grid)
        if df is None:
            return None
        df = df.drop("name")
        if fn == "histogram_quantile":
            out = nh.quantile(df, keys, self.constant(args[0]))
        elif fn == "histogram_fraction":
            out = nh.fraction(df, keys, self.constant(args[0]), self.constant(args[1]))
        elif fn == "histogram_quantiles":
            out = None
            for phi in map(self.constant, args[2:]):
                one = nh.quantile(df, keys, phi).withColumn("ls", with_label(F.col("ls"), args[0].value, F.lit(repr(phi))))
                out = one if out is None else out.unionByName(one)
        else:
            out = nh.accessor(df, keys, fn.removeprefix("histogram_"))
        return out.select(none.alias("name"), "ls", "ts", "v")

    def info(self, args: tuple, grid: Grid) -> DataFrame:
        """Labels of info metrics with the same identifying labels, added where they are absent; two different sets of them are an error."""
        by = self.info_by
        sel = args[1] if len(args) > 1 else Selector("target_info")
        name = sel.name or next((v for g in sel.matchers for k, op, v in g if k == "__name__" and op == "="), "target_info")
        wanted = sorted({k for g in sel.matchers for k, _, _ in g} - {"__name__"})
        facts = self.instant(replace(sel, name=name), grid).select(keep(F.col("ls"), list(by)).alias("key"), "ts", (keep(F.col("ls"), wanted) if wanted else without(F.col("ls"), list(by))).alias("more"))
        facts = facts.groupBy("key", "ts").agg(F.max("more").alias("more"), F.min("more").alias("other"))
        clash = F.raise_error(F.lit("info: several series with the same identifying labels have different labels")).cast(LABELS)
        facts = facts.select("key", "ts", F.when(F.col("more") == F.col("other"), F.col("more")).otherwise(clash).alias("more"))
        df = self.vector(args[0], grid).withColumn("key", keep(F.col("ls"), list(by)))
        fresh = F.filter("more", lambda e: ~F.array_contains(F.transform("ls", lambda x: x["k"]), e["k"]))
        how = "inner" if wanted else "left"
        return df.join(facts, ["key", "ts"], how).select("name", F.when(F.col("more").isNull(), F.col("ls")).otherwise(F.array_sort(F.concat("ls", fresh))).alias("ls"), "ts", "v")


def may_clash(node) -> bool:
    """Whether two series of a result could have the same labels: where labels are rewritten, or names dropped that a selector leaves open."""
    if isinstance(node, Selector):
        return node.name is None and not any(k == "__name__" and op == "=" for g in node.matchers for k, op, _ in g)
    if isinstance(node, Call) and node.fn in ("label_replace", "label_join", "info"):
        return True
    if isinstance(node, (list, tuple)):
        return any(map(may_clash, node))
    return hasattr(node, "__dataclass_fields__") and any(may_clash(getattr(node, f)) for f in node.__dataclass_fields__)


def unique(df: DataFrame) -> DataFrame:
    """A vector in which no two samples of a time have the same labels; others fail."""
    n = F.count(F.lit(1)).over(Window.partitionBy("name", "ls", "ts"))
    v = F.when(F.col("_n") > 1, F.raise_error(F.lit("vector cannot contain metrics with the same labelset")).cast("double")).otherwise(F.col("v"))
    return df.withColumn("_n", n).select("name", "ls", "ts", v.alias("v"))


def query_range(store: Store, text: str, start: int, end: int, step: int, lookback: int = LOOKBACK, info_by: tuple = INFO_BY, most_points: int = MOST_POINTS) -> DataFrame:
    """(labels map, ts ms, value) of a query on the grid start, start + step, … <= end."""
    if step <= 0 or end < start:
        raise QueryError("the grid is empty")
    grid = Grid(start, end, step)
    if grid.n > most_points:
        raise QueryError(f"more than {most_points} points for each series")
    node = parse(text)
    grid = Grid(start, start + (grid.n - 1) * step, step)
    df = Compiler(store, grid, lookback, info_by).vector(node, grid)
    if may_clash(node):
        df = unique(df)
    entries = F.transform("ls", lambda e: F.struct(e["k"], e["v"]))
    m = F.map_from_entries(entries)
    named = F.when(F.col("name").isNotNull(), F.map_concat(F.create_map(F.lit("__name__"), F.col("name")), m)).otherwise(m)
    return df.select(named.alias("labels"), F.col("ts").alias("ts_ms"), F.col("v").alias("value"))


def query_histograms(store: Store, text: str, start: int, end: int, step: int, lookback: int = LOOKBACK) -> DataFrame:
    """(labels map, ts ms, histogram) of a query whose result are native histograms."""
    grid = Grid(start, start + ((end - start) // step) * step, step)
    df = Compiler(store, grid, lookback).native(parse(text), grid)
    if df is None:
        raise QueryError("the result has no native histograms")
    m = F.map_from_entries(F.transform("ls", lambda e: F.struct(e["k"], e["v"])))
    named = F.when(F.col("name").isNotNull(), F.map_concat(F.create_map(F.lit("__name__"), F.col("name")), m)).otherwise(m)
    return df.select(named.alias("labels"), F.col("ts").alias("ts_ms"), F.struct(*HISTOGRAM).alias("histogram"))


def query(store: Store, text: str, at: int, lookback: int = LOOKBACK, info_by: tuple = INFO_BY) -> DataFrame:
    return query_range(store, text, at, at, 1, lookback, info_by)
