"""Trace queries: parser, spanset algebra and metrics.

A spanset expression compiles to one boolean column over one scan of the spans.  Conjunctions and structural operators are window
functions over a trace: with nested sets, a span has an ancestor in A if the largest right bound of the A spans before it lies beyond
it, and a descendant in A if the next left bound of an A span lies within it, so no operator compares pairs of spans.  All windows
share one shuffle by trace_id.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LABELS, fdiv, fmod, lit, with_label
from ..functions.tasks import dealt, tasks_for
from ..operators.spans import KINDS, STATUS, code_name, duration_text, laid_out, with_child_counts, with_nested_sets, with_parents, with_trace_facts
from .lexing import QueryError, duration_ms, unquote

TOKEN = re.compile(
    r"""\s*(?:
    (?P<field>(?:parent\.)?(?:span|resource|event|link|instrumentation|parent)?\.(?:"(?:[^"\\]|\\.)*"|[A-Za-z_][\w./\-]*))
  | (?P<intrinsic>(?:span|trace|event|link|instrumentation):[A-Za-z]+)
  | (?P<duration>(?:\d+(?:\.\d+)?(?:ms|us|µs|ns|[smhd]))+(?![A-Za-z0-9_]))
  | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)
  | (?P<name>[A-Za-z_]\w*)
  | (?P<op>!>>|!<<|&>>|&<<|!>|!<|!~|&>|&<|&~|=~|!=|>=|<=|>>|<<|&&|\|\||[-+*/%^(){},=<>|!~])
    )""",
    re.X,
)
#: Names of intrinsic fields and their columns.
INTRINSICS = {
    "name": "name", "duration": "duration_ns", "kind": "kind", "status": "status", "statusMessage": "status_message", "childCount": "child_count", "nestedSetLeft": "ns_left",
    "nestedSetRight": "ns_right", "nestedSetParent": "ns_parent", "traceDuration": "trace_duration_ns", "rootName": "root_name", "rootServiceName": "root_service",
    "span:name": "name", "span:duration": "duration_ns", "span:kind": "kind", "span:status": "status", "span:statusMessage": "status_message", "span:id": "span_id",
    "span:parentID": "parent_span_id", "span:childCount": "child_count", "trace:duration": "trace_duration_ns", "trace:rootName": "root_name", "trace:rootService": "root_service",
    "trace:id": "trace_id", "event:name": "event:name", "event:timeSinceStart": "event:time_since_start_ns", "link:traceID": "link:trace_id", "link:spanID": "link:span_id",
    "instrumentation:name": "instrumentation_name", "instrumentation:version": "instrumentation_version",
    "span:nestedSetLeft": "ns_left", "span:nestedSetRight": "ns_right", "span:nestedSetParent": "ns_parent",
}
NUMERIC = {"duration_ns", "child_count", "ns_left", "ns_right", "ns_parent", "trace_duration_ns", "kind", "status"}
DURATIONS = {"duration_ns", "trace_duration_ns"}
OVER_TIME = {"rate", "count_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "quantile_over_time", "histogram_over_time"}
STRUCTURAL = (">>", "<<", ">", "<", "~")


@dataclass(frozen=True)
class Field:
    scope: str  # both, span, resource, event, link, instrumentation, intrinsic
    key: str
    parent: bool = False
    text: str = ""


@dataclass(frozen=True)
class Const:
    kind: str  # string, number, bool, nil, code
    value: object


@dataclass(frozen=True)
class Math:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Test:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class Spanset:
    op: str  # select, && , || or a structural operator
    parts: tuple


@dataclass(frozen=True)
class Step:
    kind: str
    args: tuple = ()


@dataclass
class Query:
    root: Spanset
    steps: list
    hints: dict = field(default_factory=dict)


class Parser:
    def __init__(self, text: str):
        self.text, self.items, self.at = text, [], 0
        pos, end = 0, len(text.rstrip())
        while pos < end:
            m = TOKEN.match(text, pos)
            if not m or m.end() == pos:
                raise QueryError(f"cannot read {text[pos:pos + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.items[k] if k < len(self.items) else ("end", "")

    def is_(self, *values: str) -> bool:
        kind, text = self.peek()
        return kind in ("op", "name") and text in values

    def take(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def accept(self, *values: str) -> str | None:
        return self.take()[1] if self.is_(*values) else None

    def expect(self, *values: str) -> str:
        if not self.is_(*values):
            raise QueryError(f"{' or '.join(values)} expected, found {self.peek()[1]!r} in {self.text!r}")
        return self.take()[1]

    def parse(self) -> Query:
        query = Query(self.spanset_or(), [])
        while self.is_("|", "with"):
            if self.accept("with"):
                query.hints |= self.hints()
            else:
                self.expect("|")
                query.steps += self.step()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return query

    def hints(self) -> dict:
        self.expect("(")
        out = {}
        while not self.is_(")"):
            name = self.take()[1]
            self.expect("=")
            kind, text = self.take()
            out[name] = {"true": True, "false": False}.get(text, float(text) if kind == "number" else text)
            if not self.accept(","):
                break
        self.expect(")")
        return out

    # --- spansets: || over && over structural
    def spanset_or(self) -> Spanset:
        left = self.spanset_and()
        while self.accept("||"):
            left = Spanset("||", (left, self.spanset_and()))
        return left

    def spanset_and(self) -> Spanset:
        left = self.structural()
        while self.accept("&&"):
            left = Spanset("&&", (left, self.structural()))
        return left

    def structural(self) -> Spanset:
        left = self.spanset()
        while self.is_(*STRUCTURAL, *("!" + s for s in STRUCTURAL), *("&" + s for s in STRUCTURAL)):
            op = self.take()[1]
            left = Spanset(op, (left, self.spanset()))
        return left

    def spanset(self) -> Spanset:
        if self.accept("("):
            inner = self.spanset_or()
            self.expect(")")
            return inner
        self.expect("{")
        test = Const("bool", True) if self.is_("}") else self.logic_or()
        self.expect("}")
        return Spanset("select", (test,))

    # --- field expressions
    def logic_or(self):
        left = self.logic_and()
        while self.accept("||"):
            left = Logic("or", (left, self.logic_and()))
        return left

    def logic_and(self):
        left = self.comparison()
        while self.accept("&&"):
            left = Logic("and", (left, self.comparison()))
        return left

    def comparison(self):
        left = self.sum()
        if self.is_("=", "!=", "<", "<=", ">", ">=", "=~", "!~"):
            return Test(self.take()[1], left, self.sum())
        return left

    def sum(self):
        left = self.product()
        while self.is_("+", "-"):
            left = Math(self.take()[1], left, self.product())
        return left

    def product(self):
        left = self.power()
        while self.is_("*", "/", "%"):
            left = Math(self.take()[1], left, self.power())
        return left

    def power(self):
        left = self.value()
        return Math("^", left, self.power()) if self.accept("^") else left

    def value(self):
        if self.accept("("):
            e = self.logic_or()
            self.expect(")")
            return e
        if self.accept("!"):
            return Logic("not", (self.value(),))
        if self.accept("-"):
            return Math("-", Const("number", 0.0), self.value())
        kind, text = self.take()
        if kind == "string":
            return Const("string", unquote(text))
        if kind == "number":
            return Const("number", float(text))
        if kind == "duration":
            return Const("number", duration_ms(text) * 1e6)
        return self.field_of(kind, text)

    def field_of(self, kind: str, text: str):
        if kind == "field":
            m = re.fullmatch(r"(parent\.)?(?:(span|resource|event|link|instrumentation)\.|\.)?(.+)", text, re.S)
            key = unquote(m[3]) if m[3][0] == '"' else m[3]
            return Field(m[2] or "both", key, bool(m[1]), text)
        if kind == "intrinsic" and text in INTRINSICS or kind == "name" and text in INTRINSICS:
            return Field("intrinsic", INTRINSICS[text], False, text)
        if kind == "name" and text in ("true", "false"):
            return Const("bool", text == "true")
        if kind == "name" and text == "nil":
            return Const("nil", None)
        if kind == "name" and text in STATUS + KINDS:
            return Const("code", text)
        raise QueryError(f"unexpected {text!r} in {self.text!r}")

    def fields(self) -> tuple:
        self.expect("(")
        out = []
        while not self.is_(")"):
            out.append(self.sum())
            if not self.accept(","):
                break
        self.expect(")")
        return tuple(out)

    def step(self) -> list[Step]:
        if self.is_("{", "("):
            return [Step("spanset", (self.spanset_or(),))]
        name = self.take()[1]
        if name in ("by", "select"):
            return [Step(name, self.fields())]
        if name == "coalesce":
            return [Step("coalesce", self.fields())]
        if name in ("topk", "bottomk"):
            return [Step(name, (int(self.fields()[0].value),))]
        if name == "compare":
            self.expect("(")
            chosen, numbers = self.spanset_or(), []
            while self.accept(","):
                numbers.append(int(float(self.take()[1])))
            self.expect(")")
            return [Step("compare", (chosen, *numbers))]
        if name in OVER_TIME or name in ("count", "sum", "avg", "min", "max"):
            out = [Step("metric" if name in OVER_TIME else "aggregate", (name, *self.fields()))]
            if self.accept("by"):
                out.append(Step("by", self.fields()))
            if self.is_(">", "<", ">=", "<=", "=", "!="):
                op = self.take()[1]
                sign = -1 if self.accept("-") else 1
                kind, text = self.take()
                out.append(Step("filter", (op, sign * (duration_ms(text) * 1e6 if kind == "duration" else float(text)))))
            return out
        if self.is_(">", "<", ">=", "<=", "=", "!="):
            raise QueryError(f"a filter follows an aggregate, not {name!r}")
        raise QueryError(f"no pipeline stage {name!r}")


def parse(text: str) -> Query:
    return Parser(text).parse()


# --- fields as columns
def _lookup(maps: list[Column], key: str) -> Column:
    return F.coalesce(*[m[key] for m in maps])


def columns_of(f: Field) -> tuple[Column, Column, Column, Column]:
    """(string, number, boolean, repeated strings) of a field; null where the field has another type or is absent."""
    at = (lambda c: F.col(f"parent.{c}")) if f.parent else F.col
    none = lambda t: F.lit(None).cast(t)
    if f.scope == "intrinsic":
        if ":" in f.key:
            raise QueryError(f"{f.text} belongs into a comparison")
        c = at(f.key)
        return (none("string"), c.cast("double"), none("boolean"), none("array<string>")) if f.key in NUMERIC else (c.cast("string"), none("double"), none("boolean"), none("array<string>"))
    if f.scope == "instrumentation":
        return at("attrs")[f"instrumentation.{f.key}"], none("double"), none("boolean"), none("array<string>")
    service = [F.create_map(F.lit("service.name"), at("service"))]
    strings = {"span": [at("attrs")], "resource": [at("resource"), *service], "both": [at("attrs"), at("resource"), *service]}[f.scope]
    own = f.scope != "resource"
    return _lookup(strings, f.key), at("nums")[f.key] if own else none("double"), at("bools")[f.key] if own else none("boolean"), at("lists")[f.key] if own else none("array<string>")


def number_of(e) -> Column:
    if isinstance(e, Const):
        if e.kind == "number":
            return lit(e.value)
        if e.kind == "code":
            return lit(code(e.value, None))
        raise QueryError(f"{e.value!r} is no number")
    if isinstance(e, Field):
        return columns_of(e)[1]
    if isinstance(e, Math):
        a, b = number_of(e.left), number_of(e.right)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: fdiv(a, b), "%": lambda: fmod(a, b), "^": lambda: F.pow(a, b)}[e.op]()
    raise QueryError("a number is expected")


def code(name: str, f: Field | None) -> int:
    if f is not None and f.key == "kind" or name not in STATUS:
        return KINDS.index(name)
    return STATUS.index(name)


def compare(op: str, x: Column, y: Column | str) -> Column:
    if op in ("=~", "!~"):
        hit = x.rlike(f"^(?s:{y})$")
        return hit if op == "=~" else ~hit
    y = F.lit(y) if isinstance(y, str) else y
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
POSITIVE = {"!=": "=", "!~": "=~"}


def nested_test(op: str, f: Field, want: Const) -> Column:
    """Any event or link for positive operators, none for negative ones."""
    kind, _, name = f.key.partition(":") if f.scope == "intrinsic" else (f.scope, "", f.key)
    rows = F.col(kind + "s")
    value = (lambda e: e[name]) if f.scope == "intrinsic" else (lambda e: e["attrs"][name])
    if want.kind == "nil":
        some = F.coalesce(F.exists(rows, lambda e: value(e).isNotNull()), F.lit(False))
        return some if op == "!=" else ~some
    y = want.value if want.kind == "string" else lit(want.value)
    cast = (lambda e: value(e)) if want.kind == "string" else (lambda e: value(e).try_cast("double"))
    hit = F.coalesce(F.exists(rows, lambda e: F.coalesce(compare(POSITIVE.get(op, op), cast(e), y), F.lit(False))), F.lit(False))
    return ~hit if op in POSITIVE else hit


def test(e) -> Column:
    """A field expression as a boolean column that is never null."""
    if isinstance(e, Const) and e.kind == "bool":
        return F.lit(e.value)
    if isinstance(e, Field):
        return F.coalesce(columns_of(e)[2], F.lit(False))
    if isinstance(e, Logic):
        if e.op == "not":
            return ~test(e.parts[0])
        a, b = map(test, e.parts)
        return a & b if e.op == "and" else a | b
    if not isinstance(e, Test):
        raise QueryError("a condition is expected")
    op, left, right = e.op, e.left, e.right
    if isinstance(left, Const) and isinstance(right, Field):
        op, left, right = FLIP.get(op, op), right, left
    if isinstance(left, Field) and isinstance(right, Const):
        if left.scope in ("event", "link") or left.scope == "intrinsic" and ":" in left.key:
            return nested_test(op, left, right)
        if left.scope == "intrinsic" and not left.key.endswith(("_ns", "count")) and left.key not in NUMERIC and right.kind == "number":
            return F.lit(False)
        s, n, b, many = columns_of(left)
        if right.kind == "nil":
            there = s.isNotNull() | n.isNotNull() | b.isNotNull() | many.isNotNull()
            return there if op == "!=" else ~there
        if right.kind == "string":
            each = lambda x: compare(POSITIVE.get(op, op), x, right.value)
            hit = F.exists(many, lambda x: F.coalesce(each(x), F.lit(False)))
            if op in POSITIVE:
                return F.coalesce(compare(op, s, right.value), ~hit, F.lit(False))
            return F.coalesce(compare(op, s, right.value), hit, F.lit(False))
        if right.kind == "bool":
            return F.coalesce(compare(op, b, F.lit(right.value)), F.lit(False))
        y = lit(code(right.value, left) if right.kind == "code" else right.value)
        return F.coalesce(compare(op, n, y), F.lit(False))
    if isinstance(left, Field) and isinstance(right, Field):
        pairs = zip(columns_of(left)[:3], columns_of(right)[:3], strict=True)
        return F.coalesce(*[compare(op, a, b) for a, b in pairs], F.lit(False))
    return F.coalesce(compare(op, number_of(left), number_of(right)), F.lit(False))


def all_of(x, kind: type) -> list:
    """All parts of a kind in an expression."""
    if isinstance(x, kind):
        return [x]
    if isinstance(x, (list, tuple)):
        return [y for p in x for y in all_of(p, kind)]
    if hasattr(x, "__dataclass_fields__"):
        return [y for f in x.__dataclass_fields__ for y in all_of(getattr(x, f), kind)]
    return []


def selectors(s: Spanset) -> list:
    return [s.parts[0]] if s.op == "select" else [x for p in s.parts for x in selectors(p)]


def structural(s: Spanset) -> bool:
    return s.op != "select" and (s.op not in ("&&", "||") or any(map(structural, s.parts)))


class Compiler:
    """Flags of spansets on one table."""

    def __init__(self) -> None:
        self.n = 0

    def kept(self, df: DataFrame, flag: Column) -> tuple[DataFrame, Column]:
        name = f"_f{self.n}"
        self.n += 1
        return df.withColumn(name, flag), F.col(name)

    def flag(self, df: DataFrame, s: Spanset) -> tuple[DataFrame, Column]:
        if s.op == "select":
            return df, test(s.parts[0])
        df, a = self.flag(df, s.parts[0])
        df, b = self.flag(df, s.parts[1])
        if s.op == "||":
            return df, a | b
        trace = Window.partitionBy("trace_id")
        if s.op == "&&":
            df, a = self.kept(df, a)
            df, b = self.kept(df, b)
            df, both = self.kept(df, F.max(a).over(trace) & F.max(b).over(trace))
            return df, (a | b) & both
        mode, op = (s.op[0], s.op[1:]) if s.op[0] in "!&" else ("", s.op)
        df, a = self.kept(df, a)
        df, b = self.kept(df, b)
        if op in (">>", "<<"):
            df, b_hit, a_hit = self.nested(df, a, b, op)
        elif op in (">", "<"):
            df, b_hit, a_hit = self.family(df, a, b, op)
        else:
            w = Window.partitionBy("trace_id", "ns_parent")
            other = lambda x: (F.sum(x.cast("int")).over(w) - x.cast("int")) > 0
            df, b_hit = self.kept(df, other(a))
            df, a_hit = self.kept(df, other(b))
        if mode == "!":
            return df, b & ~b_hit
        return df, (b & b_hit) | (a & a_hit) if mode == "&" else b & b_hit

    def nested(self, df: DataFrame, a: Column, b: Column, op: str) -> tuple[DataFrame, Column, Column]:
        order = Window.partitionBy("trace_id").orderBy("ns_left")
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        under = lambda x: F.coalesce(F.max(F.when(x, F.col("ns_right"))).over(before) > F.col("ns_right"), F.lit(False))
        above = lambda x: F.coalesce(F.min(F.when(x, F.col("ns_left"))).over(after) < F.col("ns_right"), F.lit(False))
        df, b_hit = self.kept(df, under(a) if op == ">>" else above(a))
        df, a_hit = self.kept(df, above(b) if op == ">>" else under(b))
        return df, b_hit, a_hit

    def family(self, df: DataFrame, a: Column, b: Column, op: str) -> tuple[DataFrame, Column, Column]:
        """Each span stands once with its siblings under its parent, and once with its children."""
        role = F.explode(F.array(F.struct(F.col("ns_parent").alias("of"), F.lit(False).alias("head")), F.struct(F.col("ns_left").alias("of"), F.lit(True).alias("head"))))
        df = df.withColumn("_role", role)
        head = F.col("_role.head")
        w = Window.partitionBy("trace_id", "_role.of")
        parent_in = lambda x: ~head & F.coalesce(F.max(head & x).over(w), F.lit(False))
        child_in = lambda x: head & F.coalesce(F.max(~head & x).over(w), F.lit(False))
        df, b_hit = self.kept(df, parent_in(a) if op == ">" else child_in(a))
        df, a_hit = self.kept(df, child_in(b) if op == ">" else parent_in(b))
        span = Window.partitionBy("trace_id", "ns_left")
        df, b_any = self.kept(df, F.max(b_hit).over(span))
        df, a_any = self.kept(df, F.max(a_hit).over(span))
        return df.filter(~head).drop("_role"), b_any, a_any


def prepared(spans: DataFrame, query: Query, start_ns: int, end_ns: int) -> DataFrame:
    """The spans of the range with what the query needs besides: parents, trace facts, child counts, nested sets.

    What reaches beyond single spans is worked out for whole traces, but only for those that have a span in the range which a
    selector of the root wants: their ids are found first, by a scan of the range.
    """
    df = laid_out(spans)
    fields = all_of([query.root, *query.steps], Field)
    used = {f.key for f in fields if f.scope == "intrinsic"}
    inside = F.col("start_ns").between(start_ns, end_ns)
    children = "child_count" in used and "child_count" not in df.columns
    facts = bool(used & {"root_name", "root_service", "trace_duration_ns"}) and not {"root_name", "root_service", "trace_duration_ns"} <= set(df.columns)
    nested = (bool(used & {"ns_left", "ns_right", "ns_parent"}) or any(structural(x) for x in (query.root, *all_of(query.steps, Spanset)))) and not {"ns_left", "ns_right", "ns_parent"} <= set(df.columns)
    parents = any(f.parent for f in fields)
    if children or facts or nested or parents:
        plain = [e for e in selectors(query.root) if all(not f.parent and not (f.scope == "intrinsic" and f.key in TRACE_WIDE) for f in all_of(e, Field))]
        wanted = F.lit(False)
        for e in plain:
            wanted = wanted | test(e)
        scanned = df.filter(inside & wanted) if len(plain) == len(selectors(query.root)) else df.filter(inside)
        touched = dealt(scanned.select("trace_id"), tasks_for(spans), "trace_id").distinct()
        if children:
            df = with_child_counts(df, touched)
        if facts:
            df = with_trace_facts(df, touched)
        if nested:
            df = with_nested_sets(df, touched)
        if parents:
            df = with_parents(df, touched)
    return df.filter(inside)


#: Intrinsics that other spans of the trace decide.
TRACE_WIDE = {"child_count", "root_name", "root_service", "trace_duration_ns", "ns_left", "ns_right", "ns_parent"}


def matched(spans: DataFrame, query: Query, start_ns: int, end_ns: int) -> tuple[DataFrame, list[Step]]:
    """The spans that pass the root spanset and the stages before a metric, and the rest of the stages."""
    df = prepared(spans, query, start_ns, end_ns)
    columns, tasks = df.columns, tasks_for(spans)
    some = F.lit(False)
    for e in selectors(query.root):  # a span that no selector wants changes nothing: pushed into the scan
        some = some | test(e)
    df, flag = Compiler().flag(df.filter(some), query.root)
    df = df.filter(flag).select(*columns)
    steps, group = list(query.steps), ["trace_id"]
    agg = None
    metric = next((k for k, s in enumerate(steps) if s.kind in ("metric", "compare")), None)
    if metric is not None:
        early, late = steps[:metric], steps[metric:]
    else:
        early, late = steps, []
    made = 0
    for k, s in enumerate(early):
        if s.kind == "spanset":
            df, flag = Compiler().flag(df, s.args[0])
            df = df.filter(flag)
        elif s.kind == "by":
            for e in s.args:
                name = f"_g{made}"
                made += 1
                df = df.withColumn(name, text_of(e))
                group.append(name)
        elif s.kind == "coalesce":
            group = ["trace_id"]
        elif s.kind == "aggregate":
            w = Window.partitionBy(*group)
            fn, *args = s.args
            agg = F.count(F.lit(1)).over(w).cast("double") if fn == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](number_of(args[0])).over(w)
            df = dealt(df, tasks, *group).withColumn("_agg", agg)
        elif s.kind == "filter":
            df = df.filter(F.coalesce(compare(s.args[0], F.col("_agg"), lit(s.args[1])), F.lit(False)))
        elif s.kind in ("topk", "bottomk"):
            if agg is None:
                raise QueryError(f"{s.kind} ranks an aggregate")
            order = F.desc("_agg") if s.kind == "topk" else F.asc("_agg")
            # groups first, then back: a rank over groups, not over spans
            ranked = df.groupBy(*group).agg(F.first("_agg").alias("_agg")).orderBy(order, *group[1:], "trace_id").limit(s.args[0]).select(*group)
            same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
            on = same[0]
            for c in same[1:]:
                on &= c
            df = df.alias("l").join(ranked.alias("r"), on, "left_semi")
    return df, late


def text_of(e) -> Column:
    """A field's value as a label; null if absent."""
    if not isinstance(e, Field):
        return number_of(e).cast("string")
    if e.scope == "intrinsic" and e.key in ("kind", "status"):
        return code_name(F.col(f"parent.{e.key}" if e.parent else e.key), KINDS if e.key == "kind" else STATUS)
    if e.scope == "intrinsic" and e.key in DURATIONS:
        return duration_text(F.col(e.key))
    if e.scope in ("event", "link") or e.scope == "intrinsic" and ":" in e.key:
        kind, _, name = e.key.partition(":") if e.scope == "intrinsic" else (e.scope, "", e.key)
        first = F.get(F.col(kind + "s"), 0)
        return (first[name] if e.scope == "intrinsic" else first["attrs"][name]).cast("string")
    s, n, b, many = columns_of(e)
    number = F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise(n.cast("string"))
    return F.coalesce(s, number, b.cast("string"), F.array_join(many, ","))


def find(spans: DataFrame, text: str, start_ns: int, end_ns: int) -> DataFrame:
    """The matching spans, with their columns."""
    df, late = matched(spans, parse(text), start_ns, end_ns)
    if late:
        raise QueryError("this is a metric query")
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def search(spans: DataFrame, text: str, start_ns: int, end_ns: int, limit: int = 20, spans_per_set: int = 3) -> DataFrame:
    """(trace_id, start_ns, matched, spans): the most recent traces with a match, each with its first matching spans."""
    query = parse(text)
    df, late = matched(spans, query, start_ns, end_ns)
    if late:
        raise QueryError("this is a metric query")
    extra = [text_of(f).alias(f.text) for s in query.steps if s.kind == "select" for f in s.args if isinstance(f, Field)]
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy("start_ns", "span_id"))
    rows = df.withColumn("_rank", rank).select("trace_id", "start_ns", "_rank", F.when(F.col("_rank") <= spans_per_set, F.struct("start_ns", "span_id", "name", "duration_ns", *extra)).alias("_span"))
    out = rows.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.count(F.lit(1)).alias("matched"), F.sort_array(F.collect_list("_span")).alias("spans"))
    return out.orderBy(F.desc("start_ns"), "trace_id").limit(limit)


def _labels(by: tuple) -> Column:
    """Label set of a row: absent ones are dropped, unless all are."""
    if not by:
        return F.array().cast(LABELS)
    pairs = [F.struct(F.lit(f.text or "expr").alias("k"), text_of(f).alias("v")) for f in by]
    some = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())
    nil = F.array(*[F.struct(F.lit(f.text or "expr").alias("k"), F.lit("nil").alias("v")) for f in by])
    return F.array_sort(F.when(F.size(some) > 0, some).otherwise(nil))


def power_of_two(x: Column) -> Column:
    """The next power of two of whole numbers from 2 on; null below."""
    up = F.ceil(F.log2(F.when(x >= 2, x).otherwise(lit(2)))).cast("int")
    exact = F.when(F.pow(lit(2), up - 1) >= x, F.pow(lit(2), up - 1)).when(F.pow(lit(2), up) < x, F.pow(lit(2), up + 1)).otherwise(F.pow(lit(2), up))
    return F.when((x >= 2) & (x == F.floor(x)), exact)


def metrics(spans: DataFrame, text: str, start_ns: int, end_ns: int, step_ns: int, instant: bool = False) -> DataFrame:
    """(labels map, ts_ns, value) on the points start, start + step, … <= end; the range's end belongs to it.

    ``instant``: one point for the whole range.  ``exemplars`` finds spans to go with it.
    """
    if step_ns <= 0 or end_ns < start_ns:
        raise QueryError("the grid is empty")
    query = parse(text)
    df, late = matched(spans, query, start_ns, end_ns)
    if not late:
        raise QueryError("this is no metric query")
    scale = 1.0
    for hint in ("sample", "span_sample", "trace_sample"):
        share = query.hints.get(hint)
        if isinstance(share, float) and 0 < share < 1:  # every k-th span or trace, by hash, so that reruns agree
            k = max(1, round(1 / share))
            df = df.filter(F.pmod(F.xxhash64("trace_id") if hint == "trace_sample" else F.xxhash64("trace_id", "span_id"), F.lit(k)) == 0)
            scale = float(k)
    points = 1 if instant else (end_ns - start_ns) // step_ns + 1
    bucket = F.lit(0) if instant else F.call_function("div", F.col("start_ns") - start_ns, F.lit(step_ns)).cast("int")
    df = df.withColumn("_b", bucket)
    if late[0].kind == "compare":
        return compared(df, late[0], points, start_ns, step_ns)
    fn, *args = late[0].args
    by = next((s.args for s in late if s.kind == "by"), ())
    seconds = (end_ns - start_ns if instant else step_ns) / 1e9
    value, unit = None, 1.0
    if fn not in ("rate", "count_over_time"):
        f = args[0] if args and isinstance(args[0], Field) else Field("intrinsic", "duration_ns", False, "duration")
        if fn != "histogram_over_time" and not args:
            raise QueryError(f"{fn} needs a field")
        unit = 1e9 if f.scope == "intrinsic" and f.key in DURATIONS else 1.0
        value = number_of(f)
        if fn in ("quantile_over_time", "histogram_over_time"):
            value = power_of_two(value)
        value = value / unit
        df = df.withColumn("_v", value).filter("_v is not null and not isnan(_v)")
    rows = df.select(_labels(by).alias("labels"), "_b", *(["_v"] if value is not None else []))
    if fn == "histogram_over_time":
        name = F.regexp_replace(F.regexp_replace(F.format_string("%.9f", "_v"), r"0+$", ""), r"\.$", "")
        rows = rows.withColumn("labels", with_label(F.col("labels"), "__bucket", name))
    if fn == "quantile_over_time":
        out = quantiles(rows, [a.value for a in args[1:]])
    else:
        agg = {
            "rate": lambda: F.count(F.lit(1)) * scale / seconds, "count_over_time": lambda: F.count(F.lit(1)) * scale, "histogram_over_time": lambda: F.count(F.lit(1)) * scale,
            "sum_over_time": lambda: F.sum("_v") * scale, "avg_over_time": lambda: F.avg("_v"), "min_over_time": lambda: F.min("_v"), "max_over_time": lambda: F.max("_v"),
        }[fn]()
        out = rows.groupBy("labels", "_b").agg(agg.cast("double").alias("v"))
    if fn in ("rate", "count_over_time", "histogram_over_time", "quantile_over_time"):
        out = filled(out, points)
    for s in late[1:]:
        if s.kind == "filter":
            out = out.filter(F.coalesce(compare(s.args[0], F.col("v"), lit(s.args[1])), F.lit(False)))
        elif s.kind in ("topk", "bottomk"):
            ls = F.col("labels")
            order = Window.partitionBy("_b").orderBy(F.desc("v") if s.kind == "topk" else F.asc("v"), ls if s.kind == "topk" else ls.desc())
            out = out.filter("v <> 0").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= s.args[0])
    return out.select(F.map_from_entries("labels").alias("labels"), (F.col("_b").cast("long") * step_ns + start_ns).alias("ts_ns"), F.col("v").alias("value"))


def filled(out: DataFrame, points: int) -> DataFrame:
    """Zero at the points at which a series has no value; a series holds as many rows as the grid has points."""
    series = out.groupBy("labels").agg(F.map_from_entries(F.collect_list(F.struct("_b", "v"))).alias("m"))
    each = series.select("labels", "m", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_b"))
    return each.select("labels", "_b", F.coalesce(F.col("m")[F.col("_b")], lit(0)).alias("v"))


def quantiles(rows: DataFrame, wanted: list[float]) -> DataFrame:
    """Quantiles of power-of-two buckets, interpolated on the logarithm.  A group has a few dozen different values."""
    counts = rows.groupBy("labels", "_b", "_v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("labels", "_b").orderBy("_v")
    known = counts.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy("labels", "_b")), "last": F.lag("_v").over(w)})
    ps = F.explode(F.array(*[F.struct(F.lit(repr(q).removesuffix(".0")).alias("name"), lit(q).alias("q")) for q in wanted])).alias("p")
    asked = known.select("*", ps).withColumn("want", F.greatest(F.ceil(F.col("p.q") * F.col("total")), F.lit(1)))
    hit = asked.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
    high, inside = F.log2("_v"), F.col("want") - (F.col("upto") - F.col("n"))
    low = F.coalesce(F.log2("last"), high - 1)
    v = F.when((F.col("total") == 1) | (inside == F.col("n")), F.col("_v")).otherwise(F.pow(lit(2), low + (high - low) * inside / F.col("n")))
    return hit.select(with_label(F.col("labels"), "p", F.col("p.name")).alias("labels"), "_b", v.alias("v"))


def compared(df: DataFrame, step: Step, points: int, start_ns: int, step_ns: int) -> DataFrame:
    """Counts of attribute values of the selected spans and of the others, for the values that the selection holds most."""
    chosen, *rest = step.args
    top = rest[0] if rest else 10
    df, flag = Compiler().flag(df, chosen)
    if len(rest) == 3:
        flag = flag & F.col("start_ns").between(rest[1], rest[2])
    entries = lambda m, prefix: F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("k"), e["value"].cast("string").alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))
    number = F.transform_values("nums", lambda k, v: F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(v.cast("string")))
    own = F.array(F.struct(F.lit("name").alias("k"), F.col("name").alias("v")), F.struct(F.lit("status").alias("k"), code_name(F.col("status"), STATUS).alias("v")), F.struct(F.lit("kind").alias("k"), code_name(F.col("kind"), KINDS).alias("v")))
    service = F.when(F.col("service").isNotNull() & ~F.coalesce(F.map_contains_key("resource", F.lit("service.name")), F.lit(False)), F.create_map(F.lit("service.name"), F.col("service"))).otherwise(F.create_map().cast("map<string,string>"))
    pairs = F.concat(own, entries(F.col("attrs"), "span."), entries(number, "span."), entries(F.col("bools"), "span."), entries(F.col("resource"), "resource."), entries(service, "resource."))
    df = df.select(flag.alias("sel"), "_b", pairs.alias("pairs"))
    totals = df.groupBy("sel", "_b").agg(F.count(F.lit(1)).cast("double").alias("v"))
    each = df.select("sel", "_b", F.explode("pairs").alias("e"))
    values = each.groupBy(F.col("e.k").alias("k"), F.col("e.v").alias("x"), "sel", "_b").agg(F.count(F.lit(1)).alias("n"))
    ranks = values.groupBy("k", "x").agg(F.sum(F.when(F.col("sel"), F.col("n")).otherwise(0)).alias("chosen"))
    best = ranks.withColumn("_rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("chosen"), "x"))).filter(F.col("_rank") <= top).select("k", "x")
    sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("sel")
    grid = best.select("k", "x", sides).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    counts = grid.join(values, ["k", "x", "sel", "_b"], "left")
    side = F.when(F.col("sel"), "selection").otherwise("baseline")
    one = counts.select(F.create_map(F.lit("__meta_type"), side, F.col("k"), F.col("x")).alias("labels"), "_b", F.coalesce(F.col("n").cast("double"), lit(0)).alias("v"))
    every = df.sparkSession.range(points).select(F.col("id").cast("int").alias("_b"), sides).join(totals, ["sel", "_b"], "left")
    two = every.select(F.create_map(F.lit("__meta_type"), F.concat(side, F.lit("_total"))).alias("labels"), "_b", F.coalesce("v", lit(0)).alias("v"))
    return one.unionByName(two).select("labels", (F.col("_b").cast("long") * step_ns + start_ns).alias("ts_ns"), F.col("v").alias("value"))


def trace_by_id(spans: DataFrame, trace_id) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id)


def tag_names(spans: DataFrame) -> DataFrame:
    """(scope, tag): names of attributes, by scope."""
    df = laid_out(spans)
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    one = lambda scope, names: F.transform(names, lambda k: F.struct(F.lit(scope).alias("scope"), k.alias("tag")))
    found = F.concat(one("span", F.concat(keys(F.col("attrs")), keys(F.col("nums")), keys(F.col("bools")), keys(F.col("lists")))), one("resource", keys(F.col("resource"))))
    return df.select(F.explode(found).alias("t")).select("t.*").distinct()


def tag_values(spans: DataFrame, tag: str, where: str = "{}", start_ns: int = 0, end_ns: int = (1 << 63) - 1) -> DataFrame:
    """(value) of a field among the spans that match."""
    p = Parser(tag)
    df, _ = matched(spans, parse(where), start_ns, end_ns)
    kind, text = p.take()
    return df.select(text_of(p.field_of(kind, text)).alias("value")).filter("value is not null").distinct()


def exemplars(spans: DataFrame, text: str, start_ns: int, end_ns: int, limit: int = 100, each: int = 2) -> DataFrame:
    """(trace_id, span_id, start_ns, duration_ns): matching spans spread over the range, ``each`` from each of limit / each parts of it at most.

    The parts have whole milliseconds; which spans of a part are taken is decided by md5 of "trace/span", so reruns agree.
    """
    df, _ = matched(spans, parse(text), start_ns, end_ns)
    parts = max(1, limit // each)
    ms = lambda t: F.call_function("div", t, F.lit(1_000_000))
    width = max(1, (end_ns // 1_000_000 - start_ns // 1_000_000) // parts)
    part = F.least(F.call_function("div", ms(F.col("start_ns")) - start_ns // 1_000_000, F.lit(width)), F.lit(parts - 1))
    tie = F.md5(F.concat_ws("/", F.col("trace_id").cast("string"), F.col("span_id").cast("string")))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(tie, "trace_id", "span_id"))
    return df.withColumn("_part", part).withColumn("_rank", rank).filter(F.col("_rank") <= each).select("trace_id", "span_id", "start_ns", "duration_ns")
