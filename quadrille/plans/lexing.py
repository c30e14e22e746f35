"""Tokens that the query languages share."""

from __future__ import annotations

import re

UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
DURATION = re.compile(r"(?:\d+(?:\.\d+)?(?:ms|us|µs|ns|[smhdwy]))+")
TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n?\s*)*(?:
    (?P<duration>(?:\d+(?:\.\d+)?(?:ms|us|µs|ns|[smhdwy]))+(?![A-Za-z0-9_]))
  | (?P<bytes>\d+(?:\.\d+)?(?:[kKMGTP]i?B|B)(?![A-Za-z0-9_]))
  | (?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)
  | (?P<name>[A-Za-z_][A-Za-z0-9_:]*)
  | (?P<op>\|=|\|~|\|>|!>>|!<<|&>>|&<<|!>|!<|&>|&<|&~|=~|!~|==|!=|>=|<=|>>|<<|&&|\|\||[-+*/%^(){}\[\],=<>|!~@:.])
    )""",
    re.X,
)


class QueryError(ValueError):
    """A query that can't be parsed or has no meaning."""


def duration_ms(text: str) -> float:
    return sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|us|µs|ns|[smhdwy])", text))


def byte_count(text: str) -> float:
    n, unit = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([A-Za-z]*)", text).groups()
    scale = {"": 1, "b": 1, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "pb": 1e15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50}
    return float(n) * scale[unit.lower()]


def unquote(s: str) -> str:
    if s[0] == "`":
        return s[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s[1:-1])


def number(text: str) -> float:
    return float(int(text, 16)) if text[:2].lower() == "0x" else float(text)


class Tokens:
    """A cursor over a query's tokens."""

    def __init__(self, text: str):
        self.text, self.at, self.items = text, 0, []
        end = len(text.rstrip())
        pos = 0
        while pos < end:
            m = TOKEN.match(text, pos)
            if not m or m.end() == pos:
                if text[pos:].lstrip().startswith("#"):
                    break
                raise QueryError(f"cannot read {text[pos:pos + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            pos = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.items[k][:2] if k < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def is_(self, *values: str) -> bool:
        kind, text = self.peek()
        return kind in ("op", "name") and text in values

    def accept(self, *values: str) -> str | None:
        return self.take()[1] if self.is_(*values) else None

    def expect(self, *values: str) -> str:
        if not self.is_(*values):
            raise QueryError(f"{' or '.join(values)} expected, found {self.peek()[1]!r} in {self.text!r}")
        return self.take()[1]

    def kind(self, kind: str) -> str:
        if self.peek()[0] != kind:
            raise QueryError(f"{kind} expected, found {self.peek()[1]!r} in {self.text!r}")
        return self.take()[1]

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
