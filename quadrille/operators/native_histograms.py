"""Native histograms: merging, accessors, quantiles, fractions and trimming, on bucket rows.

A histogram is a row (key columns, schema, zero_threshold, zero_count, count, sum, pos, neg, custom): ``pos`` and ``neg`` map bucket
indexes to counts; bucket i of schema s ends at 2 ** (i * 2 ** -s).  With ``custom`` bounds, ``pos`` counts by bound instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fdiv, lit

COUNTS = "map<int,double>"


def edge(index: Column, schema: Column) -> Column:
    return F.pow(lit(2), index * F.pow(lit(2), -schema.cast("double")))


def merge(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by key at the coarsest schema and the widest zero bucket of each group; custom bounds of a group have to agree.

    Buckets are rows: they sum before they are shuffled, whatever the number of histograms.
    """
    facts = histograms.groupBy(*keys).agg(
        F.min("schema").alias("to"), F.max("zero_threshold").alias("zero_threshold"), F.sum("zero_count").alias("zero_count"), F.sum("count").alias("count"), F.sum("sum").alias("sum"),
        F.min("custom").alias("custom"), F.max("custom").alias("_other"), F.count("custom").alias("_n"), F.count(F.lit(1)).alias("_all"),
    )
    bad = (F.col("_n") > 0) & ((F.col("_n") < F.col("_all")) | (F.col("custom") != F.col("_other")))
    facts = facts.withColumn("custom", F.when(bad, F.raise_error(F.lit("histograms with different custom buckets")).cast("array<double>")).otherwise(F.col("custom"))).drop("_other", "_n", "_all")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("pos").alias("m")), F.struct(F.lit(-1).alias("side"), F.col("neg").alias("m"))))
    rows = histograms.select(*keys, "schema", sides.alias("_s")).select(*keys, "schema", "_s.side", F.explode("_s.m").alias("i", "n"))
    rows = rows.groupBy(*keys, "schema", "side", "i").agg(F.sum("n").alias("n")).join(facts.select(*keys, "to", "zero_threshold", "custom"), keys)
    index = F.when(F.col("custom").isNotNull(), F.col("i")).otherwise(F.ceil(F.col("i") / F.pow(lit(2), F.col("schema") - F.col("to"))).cast("int"))
    rows = rows.withColumn("i", index)
    in_zero = F.col("custom").isNull() & (F.col("zero_threshold") > 0) & (edge(F.col("i"), F.col("to")) <= F.col("zero_threshold"))
    summed = rows.withColumn("zero", in_zero).groupBy(*keys, "side", "i", "zero").agg(F.sum("n").alias("n"))
    pick = lambda side: F.filter(F.collect_list(F.when((F.col("side") == side) & ~F.col("zero"), F.struct("i", "n"))), lambda e: e.isNotNull())
    maps = summed.groupBy(*keys).agg(F.map_from_entries(pick(1)).alias("pos"), F.map_from_entries(pick(-1)).alias("neg"), F.sum(F.when(F.col("zero"), F.col("n")).otherwise(0.0)).alias("_more"))
    empty = F.create_map().cast(COUNTS)
    joined = facts.join(maps, keys, "left")
    return joined.select(*keys, F.col("to").alias("schema"), "zero_threshold", (F.col("zero_count") + F.coalesce("_more", lit(0))).alias("zero_count"), "count", "sum", F.coalesce("pos", empty).alias("pos"), F.coalesce("neg", empty).alias("neg"), "custom")


def scaled(histograms: DataFrame, factor: float | Column) -> DataFrame:
    times = lambda m: F.transform_values(m, lambda k, v: v * factor)
    return histograms.withColumns({"zero_count": F.col("zero_count") * factor, "count": F.col("count") * factor, "sum": F.col("sum") * factor, "pos": times("pos"), "neg": times("neg")})


def buckets(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, schema, custom, zero, total, sum, lower, upper, n) of the buckets that hold something, from the lowest on."""
    base = [*keys, "schema", "custom", F.col("count").alias("total"), "sum"]
    one = lambda m: F.col(m)
    custom = F.col("custom").isNotNull()
    bound = lambda i: F.when(i < 0, lit(-math.inf)).when(i >= F.size("custom"), lit(math.inf)).otherwise(F.get("custom", i))
    pos = histograms.select(*base, F.explode(one("pos")).alias("i", "n"))
    low = F.when(custom, F.when((F.col("i") == 0) & (bound(F.lit(0)) > 0), lit(0)).otherwise(bound(F.col("i") - 1))).otherwise(edge(F.col("i") - 1, F.col("schema")))
    high = F.when(custom, bound(F.col("i"))).otherwise(edge(F.col("i"), F.col("schema")))
    up = pos.select(*[c for c in pos.columns if c != "i"], F.lit(False).alias("zero"), low.alias("lower"), high.alias("upper"))
    neg = histograms.select(*base, F.explode(one("neg")).alias("i", "n"))
    down = neg.select(*[c for c in neg.columns if c != "i"], F.lit(False).alias("zero"), (-edge(F.col("i"), F.col("schema"))).alias("lower"), (-edge(F.col("i") - 1, F.col("schema"))).alias("upper"))
    # the zero bucket reaches only to the side on which the histogram has buckets
    to = F.col("zero_threshold")
    zero = histograms.filter("zero_count > 0").select(*base, F.col("zero_count").alias("n"), F.lit(True).alias("zero"), F.when((F.size("neg") == 0) & (F.size("pos") > 0), lit(0)).otherwise(-to).alias("lower"), F.when((F.size("pos") == 0) & (F.size("neg") > 0), lit(0)).otherwise(to).alias("upper"))
    return up.unionByName(down).unionByName(zero).filter("n <> 0")


def _inside(share: Column) -> Column:
    """The value at a share of a bucket: linear for zero and custom buckets, else on the logarithm."""
    lower, upper = F.col("lower"), F.col("upper")
    linear = lower + (upper - lower) * share
    up = F.pow(lit(2), F.log2(F.when(lower > 0, lower).otherwise(lit(1))) + (F.log2(F.when(upper > 0, upper).otherwise(lit(1))) - F.log2(F.when(lower > 0, lower).otherwise(lit(1)))) * share)
    a, b = F.log2(F.when(lower < 0, -lower).otherwise(lit(1))), F.log2(F.when(upper < 0, -upper).otherwise(lit(1)))
    down = -F.pow(lit(2), a + (b - a) * share)
    return F.when(F.col("zero") | F.col("custom").isNotNull(), linear).when(lower > 0, up).otherwise(down)


def quantile(histograms: DataFrame, keys: list[str], phi: float) -> DataFrame:
    """(keys, v).  Below 0 and above 1 the infinities; NaN for an empty histogram."""
    if not 0 <= phi <= 1:
        return histograms.select(*keys, lit(math.nan if phi != phi else math.copysign(math.inf, phi - 0.5)).alias("v"))
    w = Window.partitionBy(*keys).orderBy("lower", "upper")
    rows = buckets(histograms, keys).withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("total") * phi
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lower"), F.desc("upper"))) == 1
    found = rows.withColumn("last", last).filter(((F.col("upto") >= rank) & ((F.col("upto") - F.col("n") < rank) | (F.col("upto") == F.col("n")))) | (F.col("last") & (F.col("upto") < rank)))
    custom, lower, upper = F.col("custom").isNotNull(), F.col("lower"), F.col("upper")
    v = F.when(custom & (lower == -math.inf), upper).when(custom & (upper == math.inf), lower).when(F.col("upto") < rank, upper).otherwise(_inside((rank - F.col("upto") + F.col("n")) / F.col("n")))
    best = found.groupBy(*keys).agg(F.min_by(v, F.col("upto")).alias("v"))
    return histograms.select(*keys).join(best, keys, "left").withColumn("v", F.coalesce("v", lit(math.nan)))


def rank_of(bound: float) -> Column:
    """How many observations of a bucket lie below a bound."""
    lower, upper, n = F.col("lower"), F.col("upper"), F.col("n")
    b = lit(bound)
    linear = n * (b - lower) / (upper - lower)
    positive = lambda x: F.when(F.abs(x) > 0, F.abs(x)).otherwise(lit(1))
    share = (F.log2(positive(b)) - F.log2(positive(lower))) / (F.log2(positive(upper)) - F.log2(positive(lower)))
    inside = F.when(F.col("zero") | F.col("custom").isNotNull(), F.when(lower == -math.inf, n).when(upper == math.inf, lit(0)).otherwise(linear)).otherwise(n * share)
    return F.when(upper <= b, n).when(lower >= b, lit(0)).otherwise(inside)


def fraction(histograms: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, v): the share of observations between two bounds."""
    below = buckets(histograms, keys).groupBy(*keys).agg(F.sum(rank_of(high) - rank_of(low)).alias("n"))
    joined = histograms.select(*keys, "count").join(below, keys, "left")
    share = F.coalesce("n", lit(0)) / F.when(F.col("count") > 0, F.col("count")).otherwise(lit(1))
    value = F.when(F.col("count") > 0, share).otherwise(lit(math.nan)) if low < high else F.when(F.col("count") > 0, lit(0)).otherwise(lit(math.nan))
    return joined.select(*keys, value.alias("v"))


def middle() -> Column:
    """The value that stands for a bucket: 0 for the zero bucket, the geometric mean, or the middle for custom bounds."""
    lower, upper = F.col("lower"), F.col("upper")
    return F.when(F.col("custom").isNotNull(), (lower + upper) / 2).when(F.col("zero"), lit(0)).when(lower < 0, -F.sqrt(lower * upper)).otherwise(F.sqrt(F.abs(lower * upper)))


def accessor(histograms: DataFrame, keys: list[str], what: str) -> DataFrame:
    """(keys, v): count, sum, avg, stdvar or stddev."""
    if what in ("count", "sum"):
        return histograms.select(*keys, F.col(what).alias("v"))
    if what == "avg":
        return histograms.select(*keys, fdiv(F.col("sum"), F.col("count")).alias("v"))
    mean = F.col("sum") / F.col("total")
    spread = buckets(histograms, keys).filter("total > 0").groupBy(*keys, "total").agg(F.sum(F.col("n") * (middle() - mean) * (middle() - mean)).alias("s"))
    v = F.col("s") / F.col("total")
    out = spread.select(*keys, (F.sqrt(v) if what == "stddev" else v).alias("v"))
    return histograms.select(*keys).join(out, keys, "left").withColumn("v", F.coalesce("v", lit(math.nan)))


def trimmed(histograms: DataFrame, keys: list[str], op: str, bound: float) -> DataFrame:
    """(keys, count): observations that ``</`` keeps below, or ``>/`` above, a bound."""
    below = rank_of(bound)
    kept = buckets(histograms, keys).groupBy(*keys).agg(F.sum(below if op == "</" else F.col("n") - below).alias("count"))
    return histograms.select(*keys).join(kept, keys, "left").withColumn("count", F.coalesce("count", lit(0)))


def increases(histograms: DataFrame, keys: list[str], time: str = "ts", counter: bool = True) -> DataFrame:
    """Each histogram less the one before; of a counter, the whole where a count or a bucket has fallen, which is a reset.  The first of a series has none."""
    w = Window.partitionBy(*keys).orderBy(time)
    before = ("schema", "zero_count", "count", "sum", "pos", "neg")
    df = histograms.withColumns({f"_{c}": F.lag(c).over(w) for c in before}).filter("_count is not null")
    fell = lambda m: F.exists(F.map_entries(f"_{m}"), lambda e: F.coalesce(F.col(m)[e["key"]], lit(0)) < e["value"])
    reset = (F.col("count") < F.col("_count")) | (F.col("schema") != F.col("_schema")) | (F.col("zero_count") < F.col("_zero_count")) | fell("pos") | fell("neg")
    gone = lambda m: F.map_from_entries(F.transform(F.array_except(F.map_keys(f"_{m}"), F.map_keys(m)), lambda k: F.struct(k.alias("k"), (-F.col(f"_{m}")[k]).alias("v"))))
    less = lambda m: F.map_concat(F.transform_values(m, lambda k, v: v - F.coalesce(F.col(f"_{m}")[k], lit(0))), gone(m))
    changed = df.withColumn("_reset", reset if counter else F.lit(False))
    out = changed.withColumns({m: F.when(F.col("_reset"), F.col(m)).otherwise(less(m)) for m in ("pos", "neg")} | {c: F.when(F.col("_reset"), F.col(c)).otherwise(F.col(c) - F.col(f"_{c}")) for c in ("zero_count", "count", "sum")})
    return out.select(*histograms.columns)
