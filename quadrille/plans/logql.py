"""Log queries: stream pipelines and metrics of logs.

Rows are (ts_ns, lab, line, err): ``lab`` holds the stream's labels, metadata and parsed labels as one map.  Stages compile to built-in
expressions.  Ranges become vectors of the time-series compiler, which then does everything above them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import labels_of, keep, lit, matches, quantile, with_label, without
from . import promql
from .lexing import QueryError, byte_count, duration_ms, number, unquote
from .promql import Grid, to_steps
from .templates import template

NS = 1_000_000


@dataclass(frozen=True)
class Stage:
    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class Logs:
    matchers: tuple
    stages: tuple


@dataclass(frozen=True)
class Range:
    fn: str
    logs: Logs
    range_ms: int
    offset: int = 0
    param: float | None = None
    by: bool | None = None
    labels: tuple = ()


@dataclass(frozen=True)
class Variants:
    exprs: tuple


RANGE_FNS = {
    "count_over_time", "rate", "bytes_over_time", "bytes_rate", "rate_counter", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "first_over_time",
    "last_over_time", "stdvar_over_time", "stddev_over_time", "quantile_over_time", "absent_over_time", "present_over_time",
}
LINE_OPS = ("|=", "!=", "|~", "!~", "|>", "!>")
VALUE = r"(?:\d+(?:\.\d+)?)"


class Parser(promql.Parser):
    def logs(self) -> Logs:
        t = self.t
        matchers = self.matchers()
        if len(matchers) != 1 or not matchers[0]:
            raise QueryError("a stream selector needs matchers")
        stages = []
        while True:
            if t.is_(*LINE_OPS):
                op = t.take()[1]
                wants = [self.line_arg()]
                while t.accept("or"):
                    wants.append(self.line_arg())
                stages.append(Stage("line", (op, tuple(wants))))
            elif t.accept("|"):
                stages.append(self.stage())
            else:
                return Logs(matchers[0], tuple(stages))

    def line_arg(self) -> tuple[str, str]:
        t = self.t
        if t.accept("ip"):
            t.expect("(")
            got = ("ip", unquote(t.kind("string")))
            t.expect(")")
            return got
        return ("text", unquote(t.kind("string")))

    def pairs(self) -> tuple:
        """name or name="text", separated by commas."""
        t, out = self.t, []
        while t.peek()[0] == "name" and not (t.peek()[1] in ("by",) and False):
            name = t.take()[1]
            if t.is_("=", "!=", "=~", "!~"):
                op = t.take()[1]
                kind, text = t.take()
                out.append((name, op, unquote(text) if kind == "string" else text, kind))
            else:
                out.append((name, None, None, None))
            if not t.accept(","):
                break
        return tuple(out)

    def stage(self) -> Stage:
        t = self.t
        kind, word = t.peek()
        if kind == "name" and t.peek(1)[1] not in ("=", "!=", "=~", "!~", ">", "<", ">=", "<=", "=="):
            if word in ("json", "logfmt"):
                t.take()
                flags = []
                while t.is_("-") and t.peek(1)[1] == "-":
                    t.take(), t.take()
                    name = t.take()[1]
                    while t.accept("-"):
                        name += "-" + t.take()[1]
                    flags.append(name)
                return Stage(word, (self.pairs(), tuple(flags)))
            if word in ("regexp", "pattern", "line_format"):
                t.take()
                return Stage(word, (unquote(t.kind("string")),))
            if word in ("unpack", "decolorize"):
                t.take()
                return Stage(word)
            if word in ("label_format", "drop", "keep", "distinct"):
                t.take()
                return Stage(word, self.pairs())
            if word == "unwrap":
                t.take()
                name = t.take()[1]
                convert = None
                if t.accept("("):
                    convert, name = name, t.take()[1]
                    t.expect(")")
                return Stage("unwrap", (name, convert))
        return Stage("filter", (self.filter_or(),))

    def filter_or(self):
        left = self.filter_and()
        while self.t.accept("or"):
            left = ("or", left, self.filter_and())
        return left

    def filter_and(self):
        left = self.filter_one()
        while self.t.accept("and", ","):
            left = ("and", left, self.filter_one())
        return left

    def filter_one(self):
        t = self.t
        if t.accept("("):
            e = self.filter_or()
            t.expect(")")
            return e
        name, op = t.kind("name"), t.expect("=", "==", "!=", ">", "<", ">=", "<=", "=~", "!~")
        if t.accept("ip"):
            t.expect("(")
            want = unquote(t.kind("string"))
            t.expect(")")
            return ("test", name, op, "ip", want)
        sign = "-" if t.accept("-") else ""
        kind, text = t.take()
        return ("test", name, op, kind, unquote(text) if kind == "string" else sign + text)

    def primary(self):
        t = self.t
        kind, word = t.peek()
        if kind == "name" and word in RANGE_FNS and t.is_(word) and t.peek(1)[1] in ("(", "by", "without"):
            t.take()
            t.expect("(")
            param = None
            if t.peek()[0] == "number":
                param = number(t.take()[1])
                t.expect(",")
            logs = self.logs()
            t.expect("[")
            size = round(duration_ms(t.kind("duration")))
            t.expect("]")
            more = []
            while t.is_("|") or t.is_(*LINE_OPS):
                if t.accept("|"):
                    more.append(self.stage())
                else:
                    more.append(Stage("line", (t.take()[1], (self.line_arg(),))))
            offset = 0
            if t.accept("offset"):
                offset = round(duration_ms(t.kind("duration")))
            t.expect(")")
            by, labels = None, ()
            if t.is_("by", "without"):
                by, labels = t.take()[1] == "by", self.names()
            return Range(word, replace(logs, stages=logs.stages + tuple(more)), size, offset, param, by, labels)
        if kind == "name" and word == "variants":
            t.take()
            exprs = self.arguments()
            t.expect("of")
            t.expect("(")
            logs = self.logs()
            t.expect("[")
            t.kind("duration")
            t.expect("]")
            t.expect(")")
            del logs
            return Variants(tuple(exprs))
        if kind == "name" and word == "approx_topk":
            t.take()
            args = self.arguments()
            return promql.Aggregate("topk", args[1], args[0])
        if t.is_("{"):
            return self.logs()
        return super().primary()


def parse(text: str):
    return Parser(text).parse()


# --- values with units
def seconds(x: Column) -> Column:
    """A duration such as 1m30s in seconds; null if it is none."""
    parts = F.regexp_extract_all(x, F.lit(rf"({VALUE})(ns|us|µs|ms|s|m|h)"), 0)
    scale = lambda u: F.when(u == "ns", 1e-9).when(u.isin("us", "µs"), 1e-6).when(u == "ms", 1e-3).when(u == "s", 1.0).when(u == "m", 60.0).otherwise(3600.0)
    total = F.aggregate(parts, lit(0), lambda a, p: a + F.regexp_extract(p, VALUE, 0).cast("double") * scale(F.regexp_extract(p, "(ns|us|µs|ms|s|m|h)$", 1)))
    return F.when(x.rlike(rf"^(?:{VALUE}(?:ns|us|µs|ms|s|m|h))+$"), total)


def size_bytes(x: Column) -> Column:
    """A number of bytes such as 5KB or 2MiB; null if it is none."""
    unit = F.lower(F.regexp_extract(x, r"([A-Za-z]*)$", 1))
    scale = F.lit(None).cast("double")
    for u, n in {"": 1, "b": 1, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}.items():
        scale = F.when(unit == u, lit(n)).otherwise(scale)
    return F.when(x.rlike(rf"^{VALUE}\s*[A-Za-z]*$"), F.regexp_extract(x, VALUE, 0).cast("double") * scale)


def plain(x: Column) -> Column:
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double"))


def ip_number(x: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    p = F.split(x, r"\.")
    number = sum((F.get(p, k).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))
    return F.when(x.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def ip_range(want: str) -> tuple[int, int]:
    import ipaddress

    if "-" in want:
        low, high = want.split("-")
        return int(ipaddress.IPv4Address(low)), int(ipaddress.IPv4Address(high))
    net = ipaddress.IPv4Network(want if "/" in want else want + "/32", strict=False)
    return int(net[0]), int(net[-1])


def pattern_regex(text: str) -> tuple[str, list[str | None]]:
    """The regular expression of a pattern such as ``<ip> - <_>``, and the captures' names."""
    names, out = [], ""
    for piece in re.split(r"(<[A-Za-z_]\w*>)", text):
        if m := re.fullmatch(r"<(\w+)>", piece):
            names.append(None if m[1] == "_" else m[1])
            out += "(.*?)"
        else:
            out += re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", piece)
    return out, names


def let(x: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), body), 0)


def once(x: Column) -> Column:
    """Keep the optimiser from copying an expression into what uses it."""
    return F.when(F.spark_partition_id() >= 0, x)


PAIRS = "array<struct<key:string,value:string>>"


def clean(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_:]", "_")


def as_map(pairs: Column) -> Column:
    """A map of (key, value) pairs, of which the first of equal keys stays."""
    first = lambda ps: let(F.transform(ps, lambda p: p["key"]), lambda ks: F.filter(ps, lambda p, k: F.array_position(ks, p["key"]) == k + 1))
    return let(pairs, lambda ps: F.map_from_entries(first(ps)))


def merged(lab: Column, found: Column) -> Column:
    """Parsed labels beside known ones; a name that is taken gets the ending _extracted, and with it takes the place of an older one."""
    named = lambda p: F.struct(let(clean(p["key"]), lambda k: F.when(F.map_contains_key(lab, k), F.concat(k, F.lit("_extracted"))).otherwise(k)).alias("key"), p["value"].alias("value"))
    new = as_map(F.transform(F.map_entries(found), named))
    return let(new, lambda m: F.map_concat(F.map_filter(lab, lambda k, v: ~F.map_contains_key(m, k)), m))


def without_keys(m: Column, names: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(names))


JSON_MAP = "map<string,string>"


def json_fields(line: Column) -> Column:
    """Fields of a JSON object by cleaned names, nested ones joined by _ at any depth, without arrays and nulls; null if the line is no object.

    Of equal names the first in the line stays.  An object cannot be deeper than the line has opening braces.  Where a string
    begins with a brace, values are read with their types, to tell it from an object.
    """
    rounds = let(F.regexp_count(line, F.lit(r"\{")), lambda n: F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")))

    def flat(first: Column, kind: str, is_object, entries) -> Column:
        nested = lambda e: F.transform(entries(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit("_"), clean(x["key"])).alias("key"), x["value"].alias("value")))
        own = lambda e: F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))
        level = lambda acc, _: F.flatten(F.transform(acc, lambda e: F.when(is_object(e["value"]), F.coalesce(nested(e), own(e))).otherwise(own(e)))).cast(kind)
        start = F.transform(first, lambda e: F.struct(clean(e["key"]).alias("key"), e["value"].alias("value"))).cast(kind)
        return F.aggregate(rounds, start, level)

    typed = "array<struct<key:string,value:variant>>"
    text = flat(F.map_entries(F.from_json(line, JSON_MAP)), PAIRS, lambda v: F.coalesce(v.startswith("{"), F.lit(False)), lambda v: F.map_entries(F.from_json(v, JSON_MAP)))
    text = F.filter(text, lambda e: e["value"].isNotNull() & ~e["value"].startswith("["))
    kinds = lambda v: F.schema_of_variant(v)
    exact = flat(F.map_entries(F.from_json(line, "map<string,variant>")), typed, lambda v: F.coalesce(kinds(v).startswith("OBJECT"), F.lit(False)), lambda v: F.map_entries(v.cast("map<string,variant>")))
    exact = F.transform(F.filter(exact, lambda e: e["value"].isNotNull() & ~kinds(e["value"]).startswith("ARRAY") & (kinds(e["value"]) != "VOID")), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value")))
    return F.when(line.rlike(r"^\s*\{"), as_map(F.when(line.rlike(r'"\{|"\['), exact).otherwise(text)))


LOGFMT = r'([^\s="]+)=("(?:[^"\\]|\\.)*"|[^\s"]*)'


def logfmt_fields(line: Column, keep_empty: bool = False, only: set[str] | None = None) -> Column:
    """Fields by cleaned names, of which the first of equal ones stays; those named in ``only`` if it is given."""
    value = lambda t: let(F.regexp_extract(t, r"(?s)^[^=]+=(.*)$", 1), lambda v: F.when(v.startswith('"'), F.regexp_replace(F.regexp_replace(v, r'^"|"$', ""), r'\\(.)', "$1")).otherwise(v))
    pair = lambda t: F.struct(clean(F.regexp_extract(t, r"^([^=]+)=", 1)).alias("key"), value(t).alias("value"))
    found = F.regexp_extract_all(line, F.lit(LOGFMT), 0)
    if only is not None:
        found = F.filter(found, lambda t: clean(F.regexp_extract(t, r"^([^=]+)=", 1)).isin(*only))
    pairs = F.transform(found, pair)
    return as_map(pairs if keep_empty else F.filter(pairs, lambda p: p["value"] != ""))


def logfmt_broken(line: Column) -> Column:
    """Whether a line holds more than pairs and bare keys."""
    return F.regexp_replace(line, LOGFMT + r"(?=\s|$)", "").rlike(r'["=]')


def line_test(op: str, arg: tuple[str, str], line: Column) -> Column:
    kind, want = arg
    if kind == "ip":
        low, high = ip_range(want)
        found = F.regexp_extract_all(line, F.lit(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), 0)
        return F.exists(found, lambda a: F.coalesce(ip_number(a).between(low, high), F.lit(False)))
    if op[-1] == "=":
        return line.contains(want)
    if op[-1] == "~":
        return line.rlike(want)
    return line.rlike("(?s)" + pattern_regex(want)[0])


def filters_first(stages: tuple) -> list[Stage]:
    """Line filters before the parsers that they follow, as far as the line stays the same and no row depends on others."""
    out: list[Stage] = []
    start = 0
    for s in stages:
        if s.kind == "line":
            out.insert(start, s)
            start += 1
        else:
            out.append(s)
            if s.kind in ("unpack", "line_format", "decolorize", "distinct"):
                start = len(out)
    return out


@dataclass
class LogTable:
    """Rows (labels map, ts_ns, line, metadata map); ``ranged`` gives those of low < ts_ns <= high, or more."""

    rows: DataFrame
    ranged: Callable[[int, int], DataFrame] | None = None

    def between(self, low: int, high: int) -> DataFrame:
        return self.ranged(low, high) if self.ranged else self.rows


class LogCompiler(promql.Compiler):
    """``logs``: a LogTable, or a DataFrame (labels map, ts_ns, line, metadata map)."""

    def __init__(self, logs: DataFrame | LogTable, grid: Grid):
        self.logs = logs if isinstance(logs, LogTable) else LogTable(logs)
        self.spark, self.top, self.info_by = self.logs.rows.sparkSession, grid, promql.INFO_BY

    def rows(self, node: Logs, low: int, high: int, only: set[str] | None = None) -> DataFrame:
        """Log rows with low < ts_ns <= high that pass the pipeline.  ``only``: the labels that are wanted of what the last parser finds."""
        test = (F.col("ts_ns") > low) & (F.col("ts_ns") <= high)
        for k, op, v in node.matchers:
            test &= matches(F.col("labels")[k], op, v, absent_is_empty=False)
        df = self.logs.between(low, high).filter(test).select("ts_ns", "labels", "line", F.map_concat("labels", F.map_filter("metadata", lambda k, v: ~F.map_contains_key("labels", k))).alias("lab"), F.lit("").alias("err"))
        stages = filters_first(node.stages)
        last = max((k for k, s in enumerate(stages) if s.kind not in ("filter", "unwrap", "line")), default=-1)
        named = lambda e: named(e[1]) | named(e[2]) if e[0] in ("and", "or") else {e[1]}
        for k, s in enumerate(stages):
            if k == last and only is not None:
                for later in stages[k:]:
                    only = only | (named(later.args[0]) if later.kind == "filter" else {later.args[0]} if later.kind == "unwrap" else set())
                df = self.apply(df, s, only | {n.removesuffix("_extracted") for n in only})
            else:
                df = self.apply(df, s)
        return df

    def apply(self, df: DataFrame, s: Stage, only: set[str] | None = None) -> DataFrame:
        line, lab, err = F.col("line"), F.col("lab"), F.col("err")
        fail = lambda bad, name: F.when((err == "") & bad, F.lit(name)).otherwise(err)
        if s.kind == "line":
            op, wants = s.args
            test = line_test(op, wants[0], line)
            for w in wants[1:]:
                test |= line_test(op, w, line)
            return df.filter(~test if op[0] == "!" else test)
        if s.kind == "json":
            wanted = s.args[0]
            if wanted:
                path = lambda p: "$." + re.sub(r'\["([^"]+)"\]', r".\1", p)
                got = F.create_map(*[x for name, _, p, _ in wanted for x in (F.lit(name), F.coalesce(F.get_json_object(line, path(p or name)), F.lit("")))])
                return df.withColumn("lab", once(merged(lab, got)))
            found = json_fields(line)
            found = found if only is None else F.map_filter(found, lambda k, v: k.isin(*only))
            return df.withColumn("_f", once(found)).select("ts_ns", "labels", "line", once(F.when(F.col("_f").isNull(), lab).otherwise(merged(lab, F.col("_f")))).alias("lab"), fail(F.col("_f").isNull(), "JSONParserErr").alias("err"))
        if s.kind == "logfmt":
            wanted, flags = s.args
            df = df.withColumn("_f", once(logfmt_fields(line, "keep-empty" in flags, None if wanted else only)))
            if "strict" in flags:
                df = df.withColumn("err", fail(logfmt_broken(line), "LogfmtParserErr"))
            if wanted:
                got = F.create_map(*[x for name, _, p, _ in wanted for x in (F.lit(name), F.coalesce(F.col("_f")[re.sub(r"[^A-Za-z0-9_:]", "_", p or name)], F.lit("")))])
            else:
                got = F.col("_f")
            return df.withColumn("lab", once(merged(lab, got))).drop("_f")
        if s.kind in ("regexp", "pattern"):
            if s.kind == "regexp":
                names = re.findall(r"\((?:\?P?<(\w+)>)?(?!\?)|\((?=\?:)", re.sub(r"\\.|\[[^\]]*\]", "", s.args[0]))
                regex, groups = s.args[0].replace("(?P<", "(?<"), [n or None for n in names]
            else:
                regex, groups = pattern_regex(s.args[0])
                regex = f"(?s)^{regex}$"
            got = F.create_map(*[x for k, n in enumerate(groups, 1) if n for x in (F.lit(n), F.regexp_extract(line, regex, k))])
            return df.withColumn("lab", once(F.when(line.rlike(regex), merged(lab, got)).otherwise(lab)))
        if s.kind == "unpack":
            df = df.withColumn("_f", once(F.from_json(line, JSON_MAP)))
            own = F.map_filter("_f", lambda k, v: (k != "_entry") & v.isNotNull())
            return df.select("ts_ns", "labels", F.coalesce(F.col("_f")["_entry"], line).alias("line"), once(F.when(F.col("_f").isNull(), lab).otherwise(merged(lab, own))).alias("lab"), fail(F.col("_f").isNull(), "JSONParserErr").alias("err"))
        if s.kind == "decolorize":
            return df.withColumn("line", F.regexp_replace(line, "\x1b\\[[0-9;]*m", ""))
        if s.kind == "line_format":
            return df.withColumn("line", template(s.args[0], lab, line, F.col("ts_ns")))
        if s.kind == "label_format":
            for name, _, to, kind in s.args:
                value = template(to, lab, line, F.col("ts_ns")) if kind == "string" else lab[to]
                gone = [name] if kind == "string" else [name, to]
                rest = without_keys(lab, gone)
                df = df.withColumn("lab", F.when(value.isNull(), lab).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value))))
            return df
        if s.kind in ("drop", "keep"):
            def named(k: Column, v: Column) -> Column:
                test = F.lit(False)
                for name, op, want, _ in s.args:
                    test |= (k == name) if op is None else (k == name) & matches(v, op, want)
                return test
            return df.withColumn("lab", F.map_filter("lab", lambda k, v: ~named(k, v) if s.kind == "drop" else named(k, v)))
        if s.kind == "distinct":
            w = Window.partitionBy(labels_of(F.col("labels")), *[lab[a[0]] for a in s.args]).orderBy("ts_ns", "line")
            return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        if s.kind == "unwrap":
            name, convert = s.args
            raw = lab[name]
            v = seconds(raw) if convert in ("duration", "duration_seconds") else size_bytes(raw) if convert == "bytes" else plain(raw)
            # rows without the label have no sample; rows whose value can't be read have an error
            return df.filter(raw.isNotNull()).select("ts_ns", "labels", "line", F.map_filter("lab", lambda k, x: k != name).alias("lab"), fail(v.isNull(), "SampleExtractionErr").alias("err"), v.alias("unwrapped"))
        test, bad = self.field(s.args[0], lab, err)
        return df.withColumn("err", F.when((err == "") & bad, "LabelFilterErr").otherwise(err)).filter(test | bad)

    def field(self, e: tuple, lab: Column, err: Column) -> tuple[Column, Column]:
        """(passes, cannot be converted) of a filter on labels."""
        if e[0] in ("and", "or"):
            (a, x), (b, y) = self.field(e[1], lab, err), self.field(e[2], lab, err)
            return (a & b, x | y) if e[0] == "and" else (a | b, (x | y) & ~(a | b))
        _, name, op, kind, want = e
        raw = err if name == "__error__" else lab[name]
        if kind == "string":
            return matches(raw, "=" if op == "==" else op, want), F.lit(False)
        if kind == "ip":
            low, high = ip_range(want)
            hit = F.coalesce(ip_number(raw).between(low, high), F.lit(False))
            return (~hit if op == "!=" else hit), F.lit(False)
        value, x = {"number": lambda: (number(want.lstrip("-")) * (-1 if want[0] == "-" else 1), plain(raw)), "duration": lambda: (duration_ms(want) / 1000, seconds(raw)), "bytes": lambda: (byte_count(want), size_bytes(raw))}[kind]()
        test = {"=": x == value, "==": x == value, "!=": x != value, ">": x > value, "<": x < value, ">=": x >= value, "<=": x <= value}[op]
        return F.coalesce(test, F.lit(False)), raw.isNotNull() & x.isNull()

    def vector(self, node, grid: Grid) -> DataFrame:
        if isinstance(node, Range):
            return self.range(node, grid)
        if isinstance(node, Variants):
            out = None
            for k, e in enumerate(node.exprs):
                df = self.vector(e, grid).withColumn("ls", with_label(F.col("ls"), "__variant__", F.lit(str(k))))
                out = df if out is None else out.unionByName(df)
            return out
        return super().vector(node, grid)

    def range(self, node: Range, grid: Grid) -> DataFrame:
        fn, width, none = node.fn, node.range_ms, F.lit(None).cast("string")
        offset = node.offset * NS
        only = set(node.labels) if node.by else None
        rows = self.rows(node.logs, (grid.start - width) * NS - offset, grid.end * NS - offset, only)
        if fn == "absent_over_time":
            bad = F.when(F.col("err") != "", F.raise_error(F.concat(F.lit("pipeline error: "), F.col("err"))).cast("long")).otherwise(F.col("ts_ns") + offset)
            have = to_steps(rows.withColumn("ts", bad), Grid(grid.start * NS, grid.end * NS, grid.step * NS), width * NS).select((F.col("s") / NS).cast("long").alias("ts")).distinct()
            ls = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, op, v in sorted(node.logs.matchers) if op == "="])
            return self.steps(grid).join(have, "ts", "left_anti").select(none.alias("name"), ls.alias("ls"), "ts", lit(1).alias("v"))
        unwrapped = "unwrapped" in rows.columns
        v = F.col("unwrapped") if unwrapped else F.octet_length("line").cast("double") if fn.startswith("bytes") else lit(1)
        checked = F.when(F.col("err") != "", F.raise_error(F.concat(F.lit("pipeline error: "), F.col("err"))).cast("double")).otherwise(v)
        ls = labels_of(F.col("lab"))
        if node.by is not None:
            ls = keep(ls, list(node.labels)) if node.by else without(ls, list(node.labels))
        df = rows.select(ls.alias("ls"), (F.col("ts_ns") + offset).alias("ts"), checked.alias("v"))
        if fn == "rate_counter":
            df = df.groupBy("ls", "ts").agg(F.sum("v").alias("v"))
            df = df.withColumn("pv", F.lag("v").over(Window.partitionBy("ls").orderBy("ts")))
        fine, ns = Grid(grid.start * NS, grid.end * NS, grid.step * NS), width * NS
        x, sec = F.col("v"), width / 1000
        parts: dict[str, tuple[dict, Column]] = {
            "count_over_time": ({"n": F.count(x)}, F.col("n").cast("double")), "rate": ({"x_sum": F.sum(x)}, F.col("x_sum") / sec), "bytes_over_time": ({"x_sum": F.sum(x)}, F.col("x_sum")), "bytes_rate": ({"x_sum": F.sum(x)}, F.col("x_sum") / sec),
            "sum_over_time": ({"x_sum": F.sum(x)}, F.col("x_sum")), "avg_over_time": ({"x_sum": F.sum(x), "n": F.count(x)}, F.col("x_sum") / F.col("n")), "min_over_time": ({"x_min": F.min(x)}, F.col("x_min")), "max_over_time": ({"x_max": F.max(x)}, F.col("x_max")),
            "first_over_time": ({"t0": F.min("ts"), "v0": F.min_by(x, "ts")}, F.col("v0")), "last_over_time": ({"t1": F.max("ts"), "v1": F.max_by(x, "ts")}, F.col("v1")), "present_over_time": ({"one": F.max(F.when(x.isNotNull(), lit(1)))}, F.col("one")),
        }
        if fn in parts:
            aggs, result = parts[fn]
            out = promql.over_windows(df, fine, ns, ["ls"], aggs)
        else:
            gain = F.when(x < F.col("pv"), x).otherwise(x - F.col("pv")) if fn == "rate_counter" else None
            agg = {
                "stdvar_over_time": lambda: F.var_pop(x), "stddev_over_time": lambda: F.stddev_pop(x), "quantile_over_time": lambda: quantile(node.param, x),
                "rate_counter": lambda: (F.coalesce(F.sum(gain), lit(0)) - F.coalesce(F.min_by(gain, "ts"), lit(0))) / sec,
            }[fn]()
            out, result = to_steps(df, fine, ns).groupBy("ls", "s").agg(agg.alias("v")), F.col("v")
        return out.select(none.alias("name"), "ls", (F.col("s") / NS).cast("long").alias("ts"), result.alias("v"))


def query_logs(logs: DataFrame | LogTable, text: str, start_ns: int, end_ns: int, limit: int | None = None, forward: bool = False) -> DataFrame:
    """(labels map, ts_ns, line, err) of a stream query, newest first unless ``forward``; ``limit`` is the API's entry limit."""
    node = parse(text)
    if not isinstance(node, Logs):
        raise QueryError("this is a metric query")
    df = LogCompiler(logs, Grid(0, 0, 1)).rows(node, start_ns - 1, end_ns - 1).select(F.col("lab").alias("labels"), "ts_ns", "line", "err")
    return df if limit is None else df.orderBy(F.col("ts_ns").asc() if forward else F.col("ts_ns").desc(), "line").limit(limit)


def query_metrics(logs: DataFrame | LogTable, text: str, start: int, end: int, step: int) -> DataFrame:
    """(labels map, ts ms, value) of a metric query; both ends are aligned up to the step."""
    up = lambda t: -(-t // step) * step
    grid = Grid(up(start), up(end), step)
    df = LogCompiler(logs, grid).vector(parse(text), grid)
    return df.select(F.map_from_entries("ls").alias("labels"), F.col("ts").alias("ts_ms"), F.col("v").alias("value"))
