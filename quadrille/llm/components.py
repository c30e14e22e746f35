"""Connected components by alternating large and small stars, after forests within partitions.

Every step is a minimum by key, which sums before it shuffles, and a join with that written result, whose hot keys
adaptive execution splits.  Nothing is gathered on the driver but a count and a checksum.  The steps are many and their tables often
small: each is written by a task for every EDGES edges, LEAST tasks at least, and not by one for each shuffle partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save

EDGES, LEAST = 200_000, 8


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the pairs (a, b) and the smallest vertex of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return ids, ids[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    held = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        ids, roots = local_labels(np.concatenate(a), np.concatenate(b))
        far = ids != roots
        return ids[far], roots[far]

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > 1 << 20:
            x, y = reduced()
            a, b, held = [x], [y], len(x) // 2
    if a:
        x, y = reduced()
        for k in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]), pa.array(y[k : k + (1 << 16)])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every vertex of the two long columns of ``edges``, a written table, and the smallest one it reaches, itself included."""
    first, second = edges.columns
    own = edges.select(F.col(first).cast("long").alias("u"), F.col(second).cast("long").alias("v")).filter("u <> v")
    tasks = max(LEAST, edges.count() // EDGES)
    e = save(own.coalesce(tasks).mapInArrow(_forest, "u long, v long").distinct().coalesce(tasks))  # u > v throughout
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(e)
    while before[0]:
        tasks = max(LEAST, before[0] // EDGES)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks))
        large = save(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        parent = save(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        rest = large.join(parent, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = save(rest.unionByName(parent.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        discard(e, least, large, parent)
        e, after = small, state(small)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
