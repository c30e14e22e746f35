"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are collapsed first.  The others are rotated onto principal axes, which changes no inner product, and dealt to
tiles by splits along the leading axes.  Two tiles are compared only if their boxes come near enough; then the products
of the leading axes are accumulated first, what the remaining axes can add is bounded by the product of
suffix norms, and pairs that cannot reach the threshold are given up.  Cosines within 1e-9 of the threshold are
computed again from the vectors as given.  A pair of tiles returns the number of links of each row and a spanning forest, not the pairs.

The axes and splits are fitted on FIT_ROWS vectors at most, chosen by hash; they steer the order of work only, results do not
depend on them.  A tile never holds more than about TILE vectors: tiles grow in number.  They are numbered along the leaves of the tree, and a group of
neighbouring tiles stays in a task while the tiles of a chunk pass by one at a time; a tile is copied once for each group it has to pass, so copies
grow in proportion until groups reach MOST_GROUP tiles.  The driver holds the leaves, LEAVES at most, and no tile or pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component;
shorter vectors count as padded with zeros; a row without a vec_id links with nothing, has no component and is
kept; rows that share a vec_id share a component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen_by, discard, sample_threshold, save
from .components import components, local_labels

THRESHOLD = 0.9
TILE, FIT_ROWS, LEAVES = 2048, 4096, 512
#: A group is GROUPS-th of all tiles, MOST_GROUP at most; a chunk is two groups.
GROUPS, MOST_GROUP = 8, 64
BLOCK, AXES = 1024, 8
#: Vectors that more than one row in HOT has are HOT at most, and may be broadcast.
HOT = 1000
NEAR = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows padded to ``dims`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(float)
    sizes = np.diff(ends)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_axes(x: np.ndarray, leaves: int) -> tuple[np.ndarray, list]:
    """Principal axes of unit rows, as columns, and a tree of splits (axis, value, left, right) with leaf numbers."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    y = x @ axes
    numbers = iter(range(leaves + 1))

    def split(rows: np.ndarray, n: int):
        if n <= 1 or len(rows) < 4:
            return next(numbers)
        axis = int(np.argmax(rows[:, : AXES].var(0)))
        value = float(np.median(rows[:, axis]))
        right = rows[:, axis] > value
        if not right.any():
            return next(numbers)
        return (axis, value, split(rows[~right], n // 2), split(rows[right], n - n // 2))

    return axes, split(y, leaves)


def leaf_of(tree, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(y), np.int64)
    todo = [(tree, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            out[rows] = node
        else:
            right = y[rows, node[0]] > node[1]
            todo += [(node[2], rows[~right]), (node[3], rows[right])]
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: float, step: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of rows whose cosine can reach ``threshold``, from unit rows with leading axes first."""
    dims = a.shape[1]
    low = threshold - NEAR
    product = np.zeros((len(a), len(b)))
    for at in range(0, dims, step):
        product += a[:, at : at + step] @ b[:, at : at + step].T
        if at + step >= dims:
            i, j = np.nonzero(product >= low)
            return i, j, product[i, j]
        rest = np.sqrt((a[:, at + step :] ** 2).sum(1))[:, None] * np.sqrt((b[:, at + step :] ** 2).sum(1))
        alive = product + rest >= low
        n = np.count_nonzero(alive)
        if not n:
            break
        if n <= 0.02 * alive.size:
            i, j = np.nonzero(alive)
            cosine = product[i, j]
            for k in range(0, n, 1 << 14):
                part = slice(k, k + (1 << 14))
                cosine[part] += np.einsum("ij,ij->i", a[i[part], at + step :], b[j[part], at + step :])
            far = cosine >= low
            return i[far], j[far], cosine[far]
    return (np.empty(0, np.int64),) * 2 + (np.empty(0),)


class Tile:
    """A tile's vectors: as given, and as unit rows on the axes."""

    def __init__(self, number: int, ids: bytes, ns: bytes, xs: bytes, axes: np.ndarray, kind: type):
        self.number, self.ids, self.ns = number, np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64)
        self.raw = np.frombuffer(xs, kind).reshape(-1, len(axes))
        self.x = unit(self.raw.astype(float)) @ axes
        self.low, self.high = self.x.min(0), self.x.max(0)


def tile_links(s: Tile, t: Tile, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of two tiles that link, by blocks; each pair once if the tiles are one."""
    gap = np.maximum(0, np.maximum(s.low - t.high, t.low - s.high))
    if (gap * gap).sum() > 2 - 2 * threshold + 1e-6:  # the square of the distance of unit vectors that link
        return []
    same, out = s.number == t.number, []
    for p in range(0, len(s.x), BLOCK):
        for q in range(p if same else 0, len(t.x), BLOCK):
            i, j, cosine = linked(s.x[p : p + BLOCK], t.x[q : q + BLOCK], threshold)
            i, j = i + p, j + q
            if same:
                once = i < j
                i, j, cosine = i[once], j[once], cosine[once]
            close = np.flatnonzero(np.abs(cosine - threshold) <= NEAR)
            if len(close):
                u, v = s.raw[i[close]].astype(float), t.raw[j[close]].astype(float)
                cosine[close] = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
                good = cosine >= threshold
                i, j = i[good], j[good]
            if len(i):
                out.append((i, j))
    return out


def _compare(batches: Iterator[pa.RecordBatch], axes: np.ndarray, kind: type, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (group, chunk, passing, tile, ids, ns, xs), sorted: the tiles of a group, then those that pass it.  (rep, links, root)."""
    at, held = None, []
    for batch in batches:
        for r in range(batch.num_rows):
            group, chunk, passing, number, ids, ns, xs = (batch.column(c)[r].as_py() for c in range(7))
            if (group, chunk) != at:
                at, held = (group, chunk), []
            t = Tile(number, ids, ns, xs, axes, kind)
            if not passing:
                held.append(t)
                continue
            links: dict[int, np.ndarray] = {number: np.zeros(len(t.ids), np.int64)}
            own: dict[int, Tile] = {number: t}
            forest: list[tuple[np.ndarray, np.ndarray]] = []
            for s in held:
                if s.number > number:
                    continue
                for i, j in tile_links(s, t, threshold):
                    own[s.number] = s
                    counts = links.setdefault(s.number, np.zeros(len(s.ids), np.int64))
                    counts += np.bincount(i, t.ns[j], len(s.ids)).astype(np.int64)
                    links[number] += np.bincount(j, s.ns[i], len(t.ids)).astype(np.int64)
                    forest.append(local_labels(s.ids[i], t.ids[j]))
            if not forest:
                continue
            ids, roots = local_labels(*(np.concatenate(x) for x in zip(*forest, strict=True)))
            reps, total = (np.concatenate(x) for x in zip(*((own[k].ids, n) for k, n in links.items()), strict=True))
            reps, total = reps[total > 0], total[total > 0]
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(total), pa.array(roots[np.searchsorted(ids, reps)])], ["rep", "links", "root"])


class Layout:
    """Where tiles lie: leaf k has the tiles base[k] … base[k + 1] - 1; ``near`` says which leaves can hold a link."""

    def __init__(self, parts: list[int], low: np.ndarray, high: np.ndarray, threshold: float):
        self.base = np.cumsum([0, *parts])
        tiles = int(self.base[-1])
        self.group = min(MOST_GROUP, max(1, tiles // GROUPS))
        self.chunk = 2 * self.group
        gap = np.zeros((len(parts), len(parts)))
        for k in range(low.shape[1]):
            gap += np.maximum(0, np.maximum(low[:, None, k] - high[None, :, k], low[None, :, k] - high[:, None, k])) ** 2
        near = gap <= 2 - 2 * threshold + 1e-6
        self.upto = np.concatenate([np.zeros((len(parts), 1), np.int64), np.cumsum(near, 1)], 1)  # near leaves before each one

    def visits(self, leaf: int, size: int, first: int, last: int) -> list[int]:
        """Of the runs of ``size`` tiles that hold tiles first … last, those that hold a tile of a leaf near to ``leaf``."""
        runs = np.arange(first // size, last // size + 1)
        tiles = int(self.base[-1])
        one = np.searchsorted(self.base, runs * size, "right") - 1
        two = np.searchsorted(self.base, np.minimum((runs + 1) * size, tiles) - 1, "right") - 1
        return runs[self.upto[leaf, two + 1] > self.upto[leaf, one]].tolist()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("x"))
    fine = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("x", lambda c: c != 0)
    valid = rows.filter(F.coalesce(F.col("vec_id").isNotNull() & fine, F.lit(False)))
    other = rows.filter(~F.coalesce(F.col("vec_id").isNotNull() & fine, F.lit(False)))
    reps = save(valid.groupBy("x").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    count, dims, rows_in_all = reps.agg(F.count(F.lit(1)), F.max(F.size("x")), F.sum("n")).first()
    alone = other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return alone
    limit = sample_threshold(reps, F.lit(0), FIT_ROWS)
    sample = reps.filter(chosen_by(limit, F.lit(0), F.col("first"))).select("first", "x").limit(2 * FIT_ROWS).toArrow().sort_by("first")
    axes, tree = fit_axes(unit(matrix(sample["x"], dims)), min(LEAVES, max(1, -(-count // TILE))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dims)
            leaf = leaf_of(tree, unit(x) @ axes) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(leaf)], ["rep", "n", "x", "leaf"])

    placed = save(reps.select("x", "rep", "n").mapInArrow(place, "rep long, n long, x binary, leaf long"))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf of a partition: its rows and its box."""
        found: dict[int, list] = {}
        for batch in batches:
            leaf, y = batch.column(1).to_numpy(), unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(-1, dims).astype(float)) @ axes
            for k in np.unique(leaf).tolist():
                part = y[leaf == k]
                n, low, high = found.get(k, (0, np.inf, -np.inf))
                found[k] = [n + len(part), np.minimum(low, part.min(0)), np.maximum(high, part.max(0))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([*found]), pa.array([v[0] for v in found.values()]), *(pa.array([v[c].tolist() for v in found.values()]) for c in (1, 2))], ["leaf", "n", "low", "high"])

    by_leaf = placed.select("x", "leaf").mapInArrow(boxes, "leaf long, n long, low array<double>, high array<double>")
    ends = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(dims)]
    found = {r.leaf: r for r in by_leaf.groupBy("leaf").agg(F.sum("n").alias("n"), *ends).collect()}  # LEAVES rows at most
    numbers = sorted(found)
    low, high = (np.array([[found[k][f"{c}{d}"] for d in range(dims)] for k in numbers]) for c in ("low", "high"))
    parts = {k: -(-found[k].n // TILE) for k in numbers}
    layout, place_of = Layout([parts[k] for k in numbers], low, high, threshold), {k: i for i, k in enumerate(numbers)}
    look = lambda table: F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[F.col("leaf")]
    tile = look({k: int(layout.base[place_of[k]]) for k in numbers}) + F.pmod(F.xxhash64("rep"), look(parts))

    def pack(t: pa.Table) -> pa.Table:
        """A tile as one row, with the groups that it has to pass and, as a member of its own group, the chunks that pass it."""
        t = t.take(pa.array(np.argsort(t["rep"].to_numpy(), kind="stable")))
        number, leaf = t["tile"][0].as_py(), place_of[t["leaf"][0].as_py()]
        groups = layout.visits(leaf, layout.group, 0, number)
        chunks = layout.visits(leaf, layout.chunk, number, int(layout.base[-1]) - 1)
        return pa.table({
            "tile": t["tile"].slice(0, 1), "ids": pa.array([t["rep"].to_numpy().tobytes()], pa.binary()), "ns": pa.array([t["n"].to_numpy().tobytes()], pa.binary()),
            "xs": pa.array([b"".join(t["x"].to_pylist())], pa.binary()), "groups": pa.array([groups], pa.list_(pa.int64())), "chunks": pa.array([chunks], pa.list_(pa.int64())),
        })

    tiles = save(placed.withColumn("tile", tile).groupBy("tile").applyInArrow(pack, "tile long, ids binary, ns binary, xs binary, groups array<long>, chunks array<long>"))
    per = lambda size: F.call_function("div", F.col("tile"), F.lit(size))
    columns = ["group", "chunk", "passing", "tile", "ids", "ns", "xs"]
    held = tiles.withColumns({"group": per(layout.group), "chunk": F.explode("chunks"), "passing": F.lit(False)}).select(columns)
    passing = tiles.withColumns({"group": F.explode("groups"), "chunk": per(layout.chunk), "passing": F.lit(True)}).select(columns)
    met = held.unionByName(passing).repartition("group", "chunk").sortWithinPartitions("group", "chunk", "passing", "tile")
    links = save(met.mapInArrow(lambda it: _compare(it, axes, kind, threshold), "rep long, links long, root long"))
    discard(placed, tiles)
    sums = links.groupBy("rep").agg(F.sum("links").alias("links"))
    own = reps.select("rep", "first")
    classes = save(components(links.select("rep", "root")).withColumnRenamed("id", "rep").join(own, "rep"))
    # rows that share a vec_id hold their vectors' classes together
    several = save(valid.groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("vec_id"))
    if not several.isEmpty():
        shared = valid.join(several, "vec_id").join(reps.select("x", "rep"), "x").select("vec_id", "rep").distinct()
        tied = shared.join(shared.groupBy("vec_id").agg(F.min("rep").alias("root")), "vec_id").select("rep", "root")
        edges = save(links.select("rep", "root").unionByName(tied))
        first, classes = classes, save(components(edges).withColumnRenamed("id", "rep").join(own, "rep"))
        discard(edges, first)
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = save(
        reps.join(sums, "rep", "left").join(classes.join(least, "component").select("rep", "component_id"), "rep", "left")
        .select("x", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    )
    discard(reps, links, classes, several)
    often = known.filter(F.col("n") > rows_in_all / HOT)  # HOT vectors at most
    out = ["vec_id", "n_links", "component_id"]
    if often.isEmpty():
        joined = valid.join(known, "x").select(out)
    else:
        joined = valid.join(F.broadcast(often), "x").select(out).unionByName(
            valid.join(F.broadcast(often.select("x")), "x", "left_anti").join(known.filter(F.col("n") <= rows_in_all / HOT), "x").select(out)
        )
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(alone)
