"""Float arithmetic with IEEE results under ANSI mode, and label sets as sorted arrays of (k, v)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
LABELS = "array<struct<k:string,v:string>>"


def lit(x: float) -> Column:
    return F.lit(float(x))


def fdiv(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN."""
    zero = F.when(F.isnan(a) | (a == 0), lit(NAN)).when((a > 0) == (b.cast("string") != "-0.0"), lit(INF)).otherwise(lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, zero).otherwise(a / F.when(b == 0, lit(1)).otherwise(b))


def fmod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend; NaN for a zero divisor or an infinite dividend."""
    safe = F.when((b == 0) | F.isnan(b), lit(1)).otherwise(b)
    return F.when(F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF), lit(NAN)).when(F.abs(b) == INF, a).otherwise(a % safe)


def flog(x: Column, base: str = "e") -> Column:
    f = {"e": F.log, "2": F.log2, "10": F.log10}[base]
    safe = F.when((x > 0) & ~F.isnan(x), x).otherwise(lit(1))
    return F.when(F.isnan(x) | (x < 0), lit(NAN)).when(x == 0, lit(-INF)).otherwise(f(safe))


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison in which NaN equals nothing and is in no order."""
    some = ~F.isnan(a) & ~F.isnan(b)
    raw = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return (~some | raw) if op == "!=" else (some & raw)


def real(x: Column) -> Column:
    """NaN as NULL, for aggregates that skip it."""
    return F.when(~F.isnan(x), x)


def skip_nan(f, x: Column) -> Column:
    """min or max of the values that are not NaN; NaN if there are no others."""
    return F.coalesce(f(real(x)), lit(NAN))


def quantile(phi: Column | float, x: Column) -> Column:
    """Exact quantile with linear interpolation; out of range phi gives infinities."""
    if isinstance(phi, Column):
        raise TypeError("the quantile is a constant")
    if phi != phi:
        return F.first(lit(NAN))
    if phi < 0 or phi > 1:
        return F.first(lit(-INF if phi < 0 else INF))
    return F.percentile(x, F.lit(phi))


def labels_of(m: Column) -> Column:
    """A map as a label set."""
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))


def label(ls: Column, name: str) -> Column:
    """A label's value; null if it is absent."""
    return F.get(F.filter(ls, lambda e: e["k"] == name), 0)["v"]


def keep(ls: Column, names: list[str]) -> Column:
    return F.filter(ls, lambda e: e["k"].isin(names)) if names else F.array().cast(LABELS)


def without(ls: Column, names: list[str]) -> Column:
    return F.filter(ls, lambda e: ~e["k"].isin(names)) if names else ls


def with_label(ls: Column, name: str, value: Column) -> Column:
    """Set a label; an empty value removes it."""
    rest = without(ls, [name])
    return F.when(value == "", rest).otherwise(F.array_sort(F.concat(rest, F.array(F.struct(F.lit(name).alias("k"), value.alias("v"))))))


def matches(value: Column, op: str, want: str, absent_is_empty: bool = True) -> Column:
    """A label matcher; regular expressions are anchored.  Metric selectors see an absent label as empty, log
    selectors let an absent label match no ``=`` and every ``!~``."""
    pattern = f"^(?s:{want})$"
    if absent_is_empty:
        v = F.coalesce(value, F.lit(""))
        return {"=": v == want, "!=": v != want, "=~": v.rlike(pattern), "!~": ~v.rlike(pattern)}[op]
    test = {"=": value == want, "!=": value != want, "=~": value.rlike(pattern), "!~": ~value.rlike(pattern)}[op]
    return F.coalesce(test, F.lit(op in ("!=", "!~")))
