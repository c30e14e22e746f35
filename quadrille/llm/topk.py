"""Exact top-k by integer inner product with MaxScore over shards of postings.

A vector is a set of terms: dimension d with impact floor(256 * x_d).  A shard holds the impacts of its rows by
dimension, and the largest and smallest of each.  For a query, the posting of a term are the rows to which it adds more than nothing, and
its bound is the most that it adds.  Terms are split by a threshold that k candidates are known to reach: the essential ones are the fewest, by
falling bounds, for which a row in none of their postings stays below it.  Essential postings are traversed; the other terms are
probed, a few at a time, only for rows that are still competitive.  A query whose bounds sum to less than its threshold skips the shard.

The thresholds come from a first pass, in which each block of queries meets one shard only, and are shared by all shards of the second.
Shards merge by (score, vec_id).  Shards and blocks of queries, each one row with impacts as small as their type allows, meet by an
equi-join on (shard, block of queries); the query set, a stated part of all rows, is never broadcast.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id;
missing dimensions count as 0, an empty vector as all zeros; rows with the query's own vec_id are no candidates for it;
other repeated vec_ids are candidates of their own.  Equal rows of the query set are one query; different vectors of one id are
queries of their own, with ranks of their own.  Components so large that a score could pass 2**63 are not
supported and fail.  An empty table gives no rows; columns other than vec_id and embedding, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

K, EVERY = 5, 50
#: Rows of a shard, queries of a block: shards are copied for each block of queries, and blocks for each shard.  A table of fewer than
#: SHARDS shards has smaller ones, SMALL rows at least.
SHARD, BLOCK, SHARDS, SMALL = 16384, 16384, 16, 2048
#: Terms that are probed before the bounds are looked at again.
STEP = 8
SCALE = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null").filter(~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows padded with zeros, in the smallest type that holds them."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, sizes = flat[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    kind = np.result_type(np.int16, *(np.min_scalar_type(int(v)) for v in (out.min(initial=0), -out.max(initial=0))))
    return out.astype(kind)


def _packed(t: pa.Table, key: str) -> pa.Table:
    """A group's rows as one row: ids, tags and a row-major matrix."""
    t = t.take(pa.array(np.lexsort((t["tag"].to_numpy(), t["vec_id"].to_numpy()))))
    m = _matrix(t["v"].combine_chunks())
    one = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table({key: t[key].slice(0, 1).cast(pa.int64()), "ids": one(t["vec_id"].to_numpy()), "tags": one(t["tag"].to_numpy()), "rows": one(m), "dims": pa.array([m.shape[1]], pa.int32()), "width": pa.array([m.itemsize], pa.int32())})


def essential(gain: np.ndarray, theta: float) -> tuple[np.ndarray, int]:
    """(terms by falling bounds, how many of them are essential): a row in no posting of these stays below ``theta``."""
    terms = np.argsort(-gain, kind="stable")
    rest = np.append(np.cumsum(gain[terms][::-1])[::-1], 0.0)
    below = np.flatnonzero(rest < theta)
    return terms, int(below[0]) if len(below) else len(terms)


def max_score(q: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, theta: float = -np.inf) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of a shard for one query; ``m`` has a dimension a row, ids ascend.

    Rows that cannot reach ``theta``, a score that k rows elsewhere have, may be left out.
    """
    gain, loss = np.maximum(np.maximum(q * high, q * low), 0), np.minimum(np.minimum(q * high, q * low), 0)
    if gain.sum() < theta:
        return []
    terms, first = essential(gain, theta)
    alive = np.flatnonzero(ids != own)
    if first < len(terms):
        held = np.zeros(len(ids), bool)
        for d in terms[:first]:
            if held.all():
                break
            held |= m[d] > 0 if q[d] > 0 else m[d] < 0
        alive = alive[held[alive]]
    score = (q[terms[:first]] @ m[terms[:first]])[alive] if first else np.zeros(len(alive), m.dtype)
    at = first
    while True:
        up, down = gain[terms[at:]].sum(), loss[terms[at:]].sum()
        if len(alive) > k:  # k rows have so much already, whatever the rest takes from them
            theta = max(theta, np.partition(score, len(score) - k)[len(score) - k] + down)
        stay = score + up >= theta
        if not stay.all():
            alive, score = alive[stay], score[stay]
        if at >= len(terms) or not len(alive):
            break
        some = terms[at : at + STEP]
        score = score + q[some] @ m[np.ix_(some, alive)]
        at += STEP
    best = np.lexsort((ids[alive], -score))[:k]
    return [(int(score[b]), int(ids[alive[b]])) for b in best]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids, rows, dims, width, and the same of queries, with tags and thresholds or null)."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, rows, dims, width, qids, tags, qrows, qdims, qwidth, thetas = (batch.column(c)[r].as_py() for c in range(10))
            ids, qids, tags = (np.frombuffer(x, np.int64) for x in (ids, qids, tags))
            m, q = np.frombuffer(rows, f"i{width}").reshape(len(ids), dims), np.frombuffer(qrows, f"i{qwidth}").reshape(len(qids), qdims)
            theta = np.full(len(qids), -np.inf) if thetas is None else np.frombuffer(thetas, float)
            both = min(dims, qdims)
            m, q = np.ascontiguousarray(m[:, :both].T.astype(np.int64)), q[:, :both].astype(np.int64)  # a dimension a row
            high, low = (m.max(1), m.min(1)) if both else (np.zeros(0, np.int64),) * 2
            size = float(np.abs(q).max()) * float(max(np.abs(high).max(), np.abs(low).max())) * both if both else 0.0
            if size >= 2.0**62:
                raise OverflowError("components too large for 64-bit scores")
            if size < 2.0**52:
                m, q, high, low = (x.astype(float) for x in (m, q, high, low))  # sums stay whole numbers, and products are faster
            else:
                theta = np.nextafter(theta, -np.inf)  # scores may not be exact as doubles
            out = [(int(own), tag, found, s) for own, tag, v, t in zip(qids, tags.tolist(), q, theta, strict=True) for s, found in max_score(v, int(own), ids, m, high, low, k, t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], ["query_id", "tag", "vec_id", "score"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with the thresholds of the first pass, in the order of the block's ids; -inf where there is none."""
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            ids, tags = (np.frombuffer(batch.column(c)[r].as_py(), np.int64).tolist() for c in (1, 2))
            known = {(x["query_id"], x["tag"]): x["theta"] for x in batch.column(6)[r].as_py() or []}
            out.append(np.array([known.get(x, -np.inf) for x in zip(ids, tags, strict=True)], float).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6)), pa.array(out, pa.binary())], ["block", "ids", "tags", "rows", "dims", "width", "theta"])


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries: rows whose vec_id is divisible by ``every``."""
    rows = quantised(vectors).withColumn("tag", F.xxhash64("v"))
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "tag"])
    n, queries = (int(x or 0) for x in rows.select("vec_id").agg(F.count(F.lit(1)), F.sum((F.col("vec_id") % every == 0).cast("int"))).first())
    shards, blocks = max(1, -(-n // shard), min(SHARDS, n // SMALL)), max(1, -(-queries // block))
    packed = "ids binary, tags binary, rows binary, dims int, width int"
    # equal rows are told apart by where they stand, so that they spread too
    spread = F.xxhash64("vec_id", F.monotonically_increasing_id())
    own = save(rows.withColumn("shard", F.pmod(spread, F.lit(shards))).groupBy("shard").applyInArrow(lambda t: _packed(t, "shard"), f"shard long, {packed}"))
    ask = save(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(blocks))).groupBy("block").applyInArrow(lambda t: _packed(t, "block"), f"block long, {packed}"))
    found = "query_id long, tag long, vec_id long, score long"
    side = lambda df, theta: df.selectExpr("block", "shard", "ids qids", "tags qtags", "rows qrows", "dims qdims", "width qwidth", f"{theta} theta")
    columns = ["ids", "rows", "dims", "width", "qids", "qtags", "qrows", "qdims", "qwidth", "theta"]
    search = lambda one, two, on: one.join(two, on).select(columns).mapInArrow(lambda it: _search(it, k), found)
    first = search(own, side(ask.withColumn("shard", F.pmod("block", F.lit(shards))), "cast(null as binary)").drop("block"), "shard")
    # a lower bound of the k-th best: the least of k scores
    theta = first.groupBy("query_id", "tag").agg(F.min("score").cast("double").alias("theta"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
    theta = theta.withColumn("block", F.pmod(F.xxhash64("query_id", "tag"), F.lit(blocks)))
    lists = theta.groupBy("block").agg(F.collect_list(F.struct("query_id", "tag", "theta")).alias("known"))  # a block's queries
    told = ask.join(lists, "block", "left").mapInArrow(_told, f"block long, {packed}, theta binary")
    left = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = side(told.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))), "theta")
    every_shard = search(left, right, ["shard", "block"])
    ranked = every_shard.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
