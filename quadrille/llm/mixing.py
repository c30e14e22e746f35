"""Mixing sources to target weights by balanced sampling with the cube method.

The sources' targets come from weights by water-filling.  Each document is taken floor(r) times,
r = target / size of its source, and once more with inclusion probability frac(r).  The cube's flight phase
moves the vector of inclusion probabilities through the null space of the constraints "number of documents" and
"number of tokens", which keeps both totals, until all but two documents of a block are decided.

Blocks of BLOCK documents or fewer, chosen by hash within a source, fly independently; what they leave
undecided forms the blocks of the next level, until a source has one block, at whatever level that is.  Its last few
documents are landed together then: of all choices, the one that comes nearest to the expected totals.

Defined results: a null text has size 0; a null source comes last in order; documents with size 0 are never taken (their
words are none); repeated rows are rows of their own; an empty table gives no rows; further columns are ignored.  All randomness
comes from hashes of ids, so reruns agree whatever the partitioning.  The driver holds the sizes of the sources; more than
MOST_SOURCES of them are an error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, quoted, save, unused

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK, MOST_SOURCES = 1024, 1_000_000
#: So many of a source's documents, whatever their size, are left to the landing, which tries all choices.
RESERVE = 10
TOKEN = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Water-filling: shares by weight, none above ``most`` times its source's size."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            open_.discard(s)
        left -= sum(out[s] for s in full)
    return out


def flight(p: np.ndarray, x: np.ndarray, seed: int, reserve: int = 0) -> np.ndarray:
    """The cube's fast flight phase: p moves with sum(p) and sum(p * x) fixed until two entries or fewer are inside (0, 1),
    besides the last ``reserve`` entries, which stay for the landing."""
    p = p.astype(float).copy()
    draw = np.random.default_rng(seed).random(len(p) + 8)
    inside = np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist()
    waiting = iter(inside[: max(0, len(inside) - reserve)])
    held: list[int] = []
    step = 0
    while True:
        while len(held) < 3:
            nxt = next(waiting, None)
            if nxt is None:
                break
            held.append(nxt)
        if len(held) < 2:
            break
        if len(held) == 3:
            i, j, k = held
            u = (x[j] - x[k], x[k] - x[i], x[i] - x[j])  # the null space of rows (1, 1, 1) and x
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif x[held[0]] == x[held[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = down = np.inf
        for n, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[n]) / d), min(down, p[n] / d)
            elif d < 0:
                up, down = min(up, p[n] / -d), min(down, (1 - p[n]) / -d)
        t = up if draw[step] * (up + down) < down else -down
        step += 1
        for n, d in zip(held, u, strict=True):
            p[n] += t * d
        keep = []
        for n in held:
            if p[n] <= EPS:
                p[n] = 0.0
            elif p[n] >= 1 - EPS:
                p[n] = 1.0
            else:
                keep.append(n)
        held = keep
    return p


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decide the last few entries together: of all choices, that whose tokens, and then documents, are nearest to what is expected."""
    p = p.copy()
    last = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    choices = (np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1).astype(float)
    off = np.abs(choices @ x[last] - p[last] @ x[last]) + 0.5 * np.abs(choices.sum(1) - p[last].sum())
    p[last] = choices[int(off.argmin())]
    return p


def _fly(table: pa.Table, block: int) -> pa.Table:
    blocks = table["blocks"][0].as_py()
    last = blocks == 1
    order = np.lexsort((table["size"].to_numpy(), table["tie"].to_numpy()))
    table = table.take(pa.array(order))
    x, p = table["size"].to_numpy().astype(float), table["p"].to_numpy()
    seed = zlib.crc32(f"{table['source'][0].as_py()}/{table['block'][0].as_py()}".encode())
    # the reserve of several blocks goes on to the source's last block if that can hold it
    p = flight(p, x, seed, RESERVE if last or blocks * (RESERVE + 2) <= block else 0)
    if last:
        p = landing(p, x)
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, row_key, size, source, source_size, target, taken, copies) for each row.

    Only ids and sizes are shuffled, and of the driver's data only the sources' totals are kept: a row for each source.
    """
    spark = docs.sparkSession
    sized = save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("row_key"),
        )
    )
    groups = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(groups) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets({g.source: g.source_size for g in groups}, weights, share, most)
    facts = spark.createDataFrame([(g.source, g.source_size, float(goal[g.source]), -(-g.n // block)) for g in groups], "s string, source_size long, target double, blocks int") if groups else None
    if facts is None:
        return sized.selectExpr("doc_id", "row_key", "size", "source", "0L source_size", "0D target", "0L taken", "0 copies")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    tie = F.xxhash64("row_key", "doc_id", F.lit(11))
    rows = (
        sized.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("whole", F.least(F.floor(ratio), F.lit(int(most))).cast("int")).withColumn("p", F.when(F.col("size") == 0, 0.0).otherwise(ratio - F.col("whole")))
        .withColumn("tie", tie).withColumn("block", F.pmod("tie", "blocks").cast("int"))
    )

    def fly(table: pa.Table) -> pa.Table:
        return _fly(table, block)

    level, most_blocks = 0, max(-(-g.n // block) for g in groups)
    done, left = [], rows
    while True:
        schema = left.schema
        flown = save(left.groupBy("source", "block").applyInArrow(fly, schema))
        done.append(flown.filter((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)))
        if most_blocks == 1:
            break
        level, most_blocks = level + 1, -(-2 * most_blocks // block)
        left = flown.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).withColumn("blocks", F.ceil(F.col("blocks") * 2 / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("tie", F.lit(level)), "blocks").cast("int"))
    discard(sized)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", (F.col("whole") + F.round("p").cast("int")).cast("int")).withColumn("taken", F.col("copies") * F.col("size")).select(
        "doc_id", "row_key", "size", "source", "source_size", "target", "taken", "copies"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, of any name: each row as many times as the mix takes it.  Rows equal in id and text share out their copies."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    key, id_, copies, n, copy = unused(docs, "_key", "_id", "_copies", "_n", "_copy")
    plan = mix(docs, **options).groupBy(F.col("row_key").alias(key), ident.alias(id_)).agg(F.sort_array(F.collect_list("copies")).alias(copies))
    joined = docs.withColumns({key: F.xxhash64("doc_id", "text"), id_: ident}).join(plan, [key, id_])
    rank = F.row_number().over(Window.partitionBy(key, id_).orderBy(key))  # as the join has dealt them: no further shuffle
    taken = joined.withColumn(n, F.element_at(copies, rank)).filter(F.col(n) > 0)
    return taken.select(*[quoted(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy)).drop(copy)
