"""Go templates over a row's labels as one column expression: text, pipelines, conditions, variables and functions.

Values carry a kind: s string, i integer, f float, b boolean, t time (seconds since the epoch as a double).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexing import QueryError, unquote

TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<number>-?\d+(?:\.\d+)?)|(?P<field>\.[\w.]*)|(?P<var>\$\w*(?:\.\w+)*)|(?P<name>\w+)|(?P<op>:=|=|\||\(|\)))')


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column
    raw: object = None  # a constant's value


def text(v: Value) -> Column:
    if v.kind == "f":
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, F.format_string("%.0f", v.col)).otherwise(v.col.cast("string"))
    if v.kind == "t":
        return F.date_format(F.timestamp_seconds(v.col), "yyyy-MM-dd HH:mm:ss")
    return v.col.cast("string")


def number(v: Value) -> Column:
    return v.col.cast("double") if v.kind in "ift" else F.coalesce(text(v).try_cast("double"), F.lit(0.0))


def whole(v: Value) -> Column:
    return F.coalesce(text(v).try_cast("long"), F.floor(number(v)).cast("long"))


def true(v: Value) -> Column:
    return v.col if v.kind == "b" else text(v) != "" if v.kind == "s" else v.col != 0


def constant(v: Value, kind: type):
    if not isinstance(v.raw, kind) or isinstance(v.raw, bool):
        raise QueryError("a constant is expected in the template")
    return v.raw


def s(c: Column) -> Value:
    return Value("s", c)


def b(c: Column) -> Value:
    return Value("b", F.coalesce(c, F.lit(False)))


def f(c: Column) -> Value:
    return Value("f", c)


def i(c: Column) -> Value:
    return Value("i", c)


#: Parts of Go's reference time and their patterns in Java, longest first.
LAYOUT = [("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("-0700", "xx"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("000000000", "SSSSSSSSS"), ("000000", "SSSSSS"), ("000", "SSS")]


def java_layout(layout: str) -> str:
    out, at = "", 0
    while at < len(layout):
        for go, java in LAYOUT:
            if layout.startswith(go, at):
                out, at = out + java, at + len(go)
                break
        else:
            out, at = out + (f"'{layout[at]}'" if layout[at].isalpha() else layout[at]), at + 1
    return out


def trimmed(c: Column, chars: Column, left: bool = True, right: bool = True) -> Column:
    c = F.ltrim(c, chars) if left else c
    return F.rtrim(c, chars) if right else c


def without_prefix(c: Column, p: Column) -> Column:
    return F.when(F.startswith(c, p), F.substr(c, F.length(p) + 1)).otherwise(c)


def without_suffix(c: Column, p: Column) -> Column:
    return F.when(F.endswith(c, p), F.substr(c, F.lit(1), F.length(c) - F.length(p))).otherwise(c)


def truncated(n: int, c: Column) -> Column:
    return F.substring(c, 1, n) if n >= 0 else F.when(F.length(c) > -n, F.substring(c, n, -n)).otherwise(c)


def aligned(n: int, c: Column, left: bool) -> Column:
    if left:
        return F.rpad(c, n, " ")
    return F.when(F.length(c) > n, F.substr(c, F.length(c) - n + 1)).otherwise(F.lpad(c, n, " "))


def indented(n: int, c: Column) -> Column:
    return F.concat(F.lit(" " * n), F.replace(c, F.lit("\n"), F.lit("\n" + " " * n)))


def go_replacement(t: str) -> str:
    return re.sub(r"\$\{(\w+)\}", r"$\1", t)


def printed(form: str, args: list[Value]) -> Column:
    """printf: %s %v %d %f %q %t %x and widths."""
    parts, rest = [], iter(args)
    for piece in re.split(r"(%[-+ 0#]*\d*(?:\.\d+)?[svdfgqtxX%])", form):
        m = re.fullmatch(r"%([-+ 0#]*\d*(?:\.\d+)?)([svdfgqtxX%])", piece)
        if not m:
            parts.append(F.lit(piece))
        elif m[2] == "%":
            parts.append(F.lit("%"))
        else:
            v = next(rest, None)
            if v is None:
                raise QueryError("printf has too few arguments")
            if m[2] in "dxX":
                parts.append(F.format_string(f"%{m[1]}{m[2]}", whole(v)))
            elif m[2] in "fg":
                parts.append(F.format_string(f"%{m[1]}{m[2]}", number(v)))
            elif m[2] == "q":
                parts.append(F.concat(F.lit('"'), F.replace(text(v), F.lit('"'), F.lit('\\"')), F.lit('"')))
            else:
                parts.append(F.format_string(f"%{m[1].replace('0', '', 1) if m[1].startswith('0') else m[1]}s", text(v)))
    return F.concat(*parts) if parts else F.lit("")


def compared(op: str, x: Value, y: Value) -> Column:
    one, two = (number(x), number(y)) if x.kind in "if" and y.kind in "if" else (text(x), text(y))
    return {"eq": one == two, "ne": one != two, "lt": one < two, "le": one <= two, "gt": one > two, "ge": one >= two}[op]


def folded(op: Callable, args: list[Column]) -> Column:
    out = args[0]
    for x in args[1:]:
        out = op(out, x)
    return out


def seconds_of(v: Value) -> Column:
    from .logql import seconds

    return F.coalesce(seconds(text(v)), F.lit(0.0))


def bytes_of(v: Value) -> Column:
    from .logql import size_bytes

    return F.coalesce(size_bytes(text(v)), F.lit(0.0))


def significant(x: Column) -> Column:
    """Four significant digits, without zeros at the end."""
    digits = F.greatest(F.lit(0), 3 - F.floor(F.log10(F.when(x == 0, F.lit(1.0)).otherwise(F.abs(x)))).cast("int"))
    scale = F.pow(F.lit(10.0), digits)
    rounded = F.floor(F.abs(x) * scale + 0.5) / scale * F.signum(x)
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "+Inf").otherwise("-Inf")).otherwise(text(Value("f", F.when(F.abs(x) < float("inf"), rounded).otherwise(F.lit(0.0)))))


def humanized(x: Column, base: int) -> Column:
    """With a prefix of the metric system, or of powers of 1024: 1.234k."""
    up, down = (("", "ki", "Mi", "Gi", "Ti", "Pi", "Ei"), ()) if base == 1024 else (("", "k", "M", "G", "T", "P", "E"), ("", "m", "u", "n", "p", "f", "a"))
    size = F.abs(x)
    out = F.concat(significant(x), F.lit(""))
    for k, p in enumerate(up[1:], 1):
        out = F.when(size >= float(base**k), F.concat(significant(x / float(base**k)), F.lit(p))).otherwise(out)
    for k, p in enumerate(down[1:], 1):
        out = F.when((size > 0) & (size < float(base ** (1 - k))) & (size >= (float(base**-k) if k < len(down) - 1 else 0.0)), F.concat(significant(x * float(base**k)), F.lit(p))).otherwise(out)
    return F.when(F.isnan(x) | (size == float("inf")), significant(x)).otherwise(out)


def lasting(x: Column) -> Column:
    """Seconds as 1d 2h 3m 4s, or with a prefix below one."""
    whole, sign = F.floor(F.abs(x)).cast("long"), F.when(x < 0, "-").otherwise("")
    div = lambda n, k: F.call_function("div", n, F.lit(k))
    d, h, m, sec = div(whole, 86400), div(F.pmod(whole, F.lit(86400)), 3600), div(F.pmod(whole, F.lit(3600)), 60), F.pmod(whole, F.lit(60))
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    long = F.when(d > 0, F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"), part(sec, "s"))).when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(sec, "s"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(sec, "s")))
    return F.concat(F.when(F.abs(x) >= 60, sign).otherwise(""), F.coalesce(long, F.concat(F.when(F.abs(x) >= 1, significant(x)).otherwise(humanized(x, 1000)), F.when((x != 0) | (x == 0), "s"))))


ARITHMETIC = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.try_divide(x, y), "mod": lambda x, y: F.try_mod(x, y), "max": F.greatest, "min": F.least}


def call(name: str, a: list[Value]) -> Value:
    t = [text(v) for v in a]
    n = lambda k: int(constant(a[k], int))
    const = lambda k: str(constant(a[k], str))
    if name in ("and", "or"):
        return b(folded((lambda x, y: x & y) if name == "and" else (lambda x, y: x | y), [true(v) for v in a]))
    if name in ("eq", "ne", "lt", "le", "gt", "ge"):
        return b(folded(lambda x, y: x | y, [compared(name, a[0], v) for v in a[1:]]))
    if name in ARITHMETIC:
        got = folded(ARITHMETIC[name], [whole(v) for v in a])
        return i((F.when(got < 0, F.ceil(got)).otherwise(F.floor(got)) if name == "div" else got).cast("long"))
    if name[-1] == "f" and name[:-1] in ARITHMETIC:
        return f(folded(ARITHMETIC[name[:-1]], [number(v) for v in a]))
    table: dict[str, Callable[[], Value]] = {
        "ToUpper": lambda: s(F.upper(t[0])), "upper": lambda: s(F.upper(t[0])), "ToLower": lambda: s(F.lower(t[0])), "lower": lambda: s(F.lower(t[0])), "title": lambda: s(F.initcap(t[0])), "Title": lambda: s(F.initcap(t[0])),
        "trim": lambda: s(trimmed(t[0], F.lit(" \t\n\r"))), "TrimSpace": lambda: s(trimmed(t[0], F.lit(" \t\n\r"))), "trimAll": lambda: s(trimmed(t[1], t[0])), "Trim": lambda: s(trimmed(t[0], t[1])),
        "TrimLeft": lambda: s(trimmed(t[0], t[1], right=False)), "TrimRight": lambda: s(trimmed(t[0], t[1], left=False)),
        "trimPrefix": lambda: s(without_prefix(t[1], t[0])), "TrimPrefix": lambda: s(without_prefix(t[0], t[1])), "trimSuffix": lambda: s(without_suffix(t[1], t[0])), "TrimSuffix": lambda: s(without_suffix(t[0], t[1])),
        "replace": lambda: s(F.replace(t[2], t[0], t[1])), "Replace": lambda: s(F.replace(t[0], t[1], t[2])), "trunc": lambda: s(truncated(n(0), t[1])),
        "substr": lambda: s(F.substr(t[2], F.lit(max(0, n(0)) + 1), F.lit(max(0, n(1) - max(0, n(0))))) if n(1) >= 0 else F.substr(t[2], F.lit(n(0) + 1))),
        "contains": lambda: b(F.contains(t[1], t[0])), "hasPrefix": lambda: b(F.startswith(t[1], t[0])), "hasSuffix": lambda: b(F.endswith(t[1], t[0])), "indent": lambda: s(indented(n(0), t[1])), "nindent": lambda: s(F.concat(F.lit("\n"), indented(n(0), t[1]))),
        "repeat": lambda: s(F.repeat(t[1], n(0))), "count": lambda: i(F.regexp_count(t[1], F.lit(const(0))).cast("long")),
        "regexReplaceAll": lambda: s(F.regexp_replace(t[1], const(0), go_replacement(const(2)))), "regexReplaceAllLiteral": lambda: s(F.regexp_replace(t[1], const(0), re.sub(r"([\\$])", r"\\\1", const(2)))),
        "urlencode": lambda: s(F.url_encode(t[0])), "urlquery": lambda: s(F.url_encode(t[0])), "urldecode": lambda: s(F.url_decode(t[0])), "b64enc": lambda: s(F.base64(F.encode(t[0], "UTF-8"))), "b64dec": lambda: s(F.decode(F.unbase64(t[0]), "UTF-8")),
        "html": lambda: s(folded(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [t[0], ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")])),
        "alignLeft": lambda: s(aligned(n(0), t[1], True)), "alignRight": lambda: s(aligned(n(0), t[1], False)), "default": lambda: s(F.when(true(a[1]), t[1]).otherwise(t[0])), "len": lambda: i(F.octet_length(t[0]).cast("long")),
        "print": lambda: s(F.concat(*t)), "printf": lambda: s(printed(const(0), a[1:])), "not": lambda: b(~true(a[0])), "sha256sum": lambda: s(F.sha2(t[0], 256)), "sha1sum": lambda: s(F.sha1(t[0])), "md5sum": lambda: s(F.md5(t[0])),
        "int": lambda: i(whole(a[0])), "float64": lambda: f(number(a[0])), "ceil": lambda: f(F.ceil(number(a[0])).cast("double")), "floor": lambda: f(F.floor(number(a[0])).cast("double")), "round": lambda: f(F.round(number(a[0]), n(1) if len(a) > 1 else 0)),
        "duration": lambda: f(seconds_of(a[0])), "duration_seconds": lambda: f(seconds_of(a[0])), "bytes": lambda: f(bytes_of(a[0])),
        "unixEpoch": lambda: s(F.floor(number(a[0])).cast("long").cast("string")), "unixEpochMillis": lambda: s(F.floor(number(a[0]) * 1000).cast("long").cast("string")), "unixEpochNanos": lambda: s((F.floor(number(a[0]) * 1_000_000).cast("long") * 1000).cast("string")),
        "unixToTime": lambda: Value("t", F.when(F.length(t[0]) == 5, number(a[0]) * 86400).when(F.length(t[0]) == 10, number(a[0])).when(F.length(t[0]) == 13, number(a[0]) / 1e3).when(F.length(t[0]) == 16, number(a[0]) / 1e6).otherwise(number(a[0]) / 1e9)),
        "humanize": lambda: s(humanized(number(a[0]), 1000)), "humanize1024": lambda: s(humanized(number(a[0]), 1024)), "humanizePercentage": lambda: s(F.concat(significant(number(a[0]) * 100), F.lit("%"))), "humanizeDuration": lambda: s(lasting(number(a[0]))),
        "humanizeTimestamp": lambda: s(F.date_format(F.timestamp_seconds(number(a[0])), "yyyy-MM-dd HH:mm:ss 'UTC'")), "toUpper": lambda: s(F.upper(t[0])), "toLower": lambda: s(F.lower(t[0])), "reReplaceAll": lambda: s(F.regexp_replace(t[2], const(0), go_replacement(const(1)))),
        "match": lambda: b(t[1].rlike(const(0))), "stripPort": lambda: s(F.regexp_replace(t[0], r":\d+$", "")), "parseDuration": lambda: f(seconds_of(a[0])),
        "toDate": lambda: Value("t", F.unix_micros(F.try_to_timestamp(t[1], F.lit(java_layout(const(0))))) / 1e6), "date": lambda: s(F.date_format(F.timestamp_seconds(number(a[1])), java_layout(const(0)))),
    }
    if name not in table:
        raise QueryError(f"no template function {name}")
    try:
        return table[name]()
    except IndexError:
        raise QueryError(f"{name} has too few arguments") from None


class Template:
    """A parsed template; ``render`` makes the column."""

    def __init__(self, source: str, lab: Column, line: Column, ts: Column | None = None, variables: dict[str, Value] | None = None):
        self.lab, self.line, self.ts, self.variables = lab, line, ts, variables or {}
        self.parts: list[tuple[str, str]] = []
        trim = False
        for piece in re.split(r'(\{\{(?:"(?:[^"\\]|\\.)*"|`[^`]*`|/\*.*?\*/|[^"`}]|\}(?!\}))*\}\})', source, flags=re.S):
            if piece.startswith("{{") and piece.endswith("}}") and len(piece) >= 4:
                inner = piece[2:-2]
                if re.match(r"-\s", inner) and self.parts and self.parts[-1][0] == "text":
                    self.parts[-1] = ("text", self.parts[-1][1].rstrip())
                trim = bool(re.search(r"\s-$", inner))
                inner = re.sub(r"^-(?=\s)|(?<=\s)-$", "", inner).strip()
                if not re.fullmatch(r"/\*.*\*/", inner, re.S):
                    self.parts.append(("action", inner))
            elif piece:
                self.parts.append(("text", piece.lstrip() if trim else piece))
                trim = False
        self.at = 0

    def render(self) -> Column:
        out, end = self.block(dict(self.variables), None)
        if end:
            raise QueryError(f"{end!r} without a beginning in a template")
        return out

    def block(self, env: dict[str, Value], dot: Value | None) -> tuple[Column, str]:
        """Up to an else, an end, or the template's end."""
        cols: list[Column] = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                cols.append(F.lit(body))
                continue
            word = body.split(None, 1)[0] if body else ""
            if word in ("else", "end"):
                return (F.concat(*cols) if cols else F.lit("")), body
            if word in ("if", "with"):
                cols.append(self.choice(word, body[len(word):], env, dot))
            elif word in ("range", "template", "define", "block"):
                raise QueryError(f"{word!r} is not supported in templates")
            elif m := re.match(r"(\$\w+)\s*:?=\s*(.*)$", body, re.S):
                env[m[1]] = self.pipeline(m[2], env, dot)
            else:
                cols.append(F.coalesce(text(self.pipeline(body, env, dot)), F.lit("")))
        return (F.concat(*cols) if cols else F.lit("")), ""

    def choice(self, word: str, condition: str, env: dict[str, Value], dot: Value | None) -> Column:
        v = self.pipeline(condition, env, dot)
        yes, end = self.block(dict(env), v if word == "with" else dot)
        no = F.lit("")
        if end.startswith("else"):
            rest = end[4:].strip()
            if rest:
                nested = rest.split(None, 1)
                no = self.choice(nested[0], nested[1], dict(env), dot)
                return F.when(true(v), yes).otherwise(no)
            no, end = self.block(dict(env), dot)
        if end != "end":
            raise QueryError(f"{word!r} without an end in a template")
        return F.when(true(v), yes).otherwise(no)

    def pipeline(self, source: str, env: dict[str, Value], dot: Value | None) -> Value:
        tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise QueryError(f"cannot read {source[at:]!r} in a template")
            tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        tokens.append(("end", ""))
        got, at = self.commands(tokens, 0, env, dot)
        if tokens[at][0] != "end":
            raise QueryError(f"unexpected {tokens[at][1]!r} in a template")
        return got

    def commands(self, tokens: list, at: int, env: dict, dot: Value | None) -> tuple[Value, int]:
        piped: Value | None = None
        while True:
            args: list[Value] = []
            name = None
            if tokens[at][0] == "name" and tokens[at][1] not in ("true", "false", "__line__", "__timestamp__"):
                name, at = tokens[at][1], at + 1
                if name in ("__line__", "__timestamp__"):
                    name = None
            while tokens[at][0] != "end" and tokens[at][1] not in ("|", ")") or tokens[at][0] == "string":
                v, at = self.operand(tokens, at, env, dot)
                args.append(v)
            if piped is not None:
                args.append(piped)
            if name is not None:
                piped = call(name, args)
            elif len(args) == 1:
                piped = args[0]
            else:
                raise QueryError("a template command is a value or a function with arguments")
            if tokens[at][1] != "|" or tokens[at][0] != "op":
                return piped, at
            at += 1

    def operand(self, tokens: list, at: int, env: dict, dot: Value | None) -> tuple[Value, int]:
        kind, word = tokens[at]
        if kind == "string":
            return Value("s", F.lit(unquote(word)), unquote(word)), at + 1
        if kind == "number":
            x = float(word) if "." in word else int(word)
            return Value("f" if "." in word else "i", F.lit(x) if isinstance(x, float) else F.lit(x).cast("long"), x), at + 1
        if kind == "field":
            if word == ".":
                return dot or s(F.to_json(self.lab)), at + 1
            return s(F.coalesce(self.lab[word[1:]], F.lit(""))), at + 1
        if kind == "var":
            if word.startswith("$labels."):
                return s(F.coalesce(self.lab[word[8:]], F.lit(""))), at + 1
            if word not in env:
                raise QueryError(f"no variable {word} in the template")
            return env[word], at + 1
        if word in ("true", "false"):
            return Value("b", F.lit(word == "true"), word == "true"), at + 1
        if word == "__line__":
            return s(self.line), at + 1
        if word == "__timestamp__":
            if self.ts is None:
                raise QueryError("there is no timestamp here")
            return Value("t", self.ts / 1e9), at + 1
        if (kind, word) == ("op", "("):
            v, at = self.commands(tokens, at + 1, env, dot)
            if tokens[at] != ("op", ")"):
                raise QueryError("a parenthesis is not closed in a template")
            return v, at + 1
        if kind == "name":  # a function without arguments
            return call(word, []), at + 1
        raise QueryError(f"unexpected {word!r} in a template")


def template(source: str, lab: Column, line: Column, ts: Column | None = None) -> Column:
    return Template(source, lab, line, ts).render()


def alert_text(source: str, labels: Column, value: Column) -> Column:
    """An annotation or label of an alert: ``$labels.name``, ``$value`` and the functions above."""
    return Template(source, labels, F.lit(""), variables={"$value": Value("f", value)}).render()
