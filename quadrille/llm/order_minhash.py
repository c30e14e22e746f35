"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of K-word shingles (words: runs of letters, digits and underscores, lower case), each
labelled with its occurrence, so that all are different.  A sketch takes the SAMPLE labelled shingles with the smallest hashes under
one hash function and keeps them in the order of the text; documents that agree on one of the SKETCHES sketches
are candidates.  Short documents, whose samples would be most of their text, have single minima besides.

Two documents link if an alignment of their shingles, the longest chain of equal ones in the same
order, has length A with A / (n + m - A) >= THRESHOLD.  Such an alignment skips at most
(n + m) * (1 - THRESHOLD) / (1 + THRESHOLD) shingles, so only matches within that band off the diagonal are
aligned.  A chain of labelled shingles that is long enough settles it; if there is none and a text repeats shingles, any two equal ones
may match: labels behind an inserted or lost occurrence are shifted.  One changed word breaks K shingles, so THRESHOLD allows
about 1 changed word in 45.

Before texts are fetched, candidates are held against bitmaps of their labelled shingles: a bit that one has and the other lacks
is a shingle that the other lacks, so a pair with more of them than an alignment may skip cannot link.  This gives up no pair that links.

Equal word sequences are one text from the start and are sketched once.  In each bucket all texts are
compared with its first.  A bucket that then still holds several components is dealt to blocks of BLOCK texts, or of BLOCK_SHINGLES
shingles, by size and component; blocks whose sizes are too different, or that hold one and the same component, do not meet.
Others meet in pairs, first by bitmaps, which leaves the texts that can have a partner at all, then by
all their shingles.  A pair of blocks returns a forest of its links: no pair of documents becomes a row, and no pair of a bucket
that links is lost.  No bucket, class or link is gathered in one task or on the driver.

Defined results: texts that are null or hold no word are classes of their own; texts shorter than K words have one shingle;
a row without doc_id has no class and is kept; rows that share a doc_id share a class, whatever their texts; an empty table gives no
rows; further columns, of any name, are ignored by ``classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mix64, quoted, save, unused
from .components import components

K, THRESHOLD = 5, 0.8
SKETCHES, SAMPLE = 32, 6
#: Documents with so many shingles or fewer have SHORT_SKETCHES single minima besides; below SHORT the samples alone are too unsure.
SHORT, SHORT_SKETCHES = 30, 8
#: The bucket blocks: texts of the first comparison (a text's bitmap counts as one more for each UNIT bytes), shingles of the second.
BLOCK, UNIT, BLOCK_SHINGLES = 512, 256, 200_000
#: So many rows of an alignment share one window of columns.
ROWS = 1024
CACHE_WORDS = 200_000
WORDS = re.compile(r"\w+").findall
SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
GOLD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SKETCHED = "doc_id long, text_hash long, c1 long, c2 long, n int, bits binary, keys array<long>"


class Shingler:
    """Labelled shingle hashes of texts; word hashes are kept."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        found, kept = WORDS((text or "").lower()), self.kept
        if len(kept) > CACHE_WORDS:
            kept.clear()
        for w in set(found).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter((kept[w] for w in found), np.uint64, len(found))

    def shingles(self, words: np.ndarray, k: int = K) -> np.ndarray:
        """One hash for each shingle, in order."""
        if not len(words):
            return words
        n = max(1, len(words) - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(min(k, len(words))):
            h = h * STEP + words[j : j + n]
        return mix64(h)

    def labelled(self, words: np.ndarray, k: int = K) -> np.ndarray:
        """One hash for each shingle, in order; equal shingles differ by their occurrence."""
        return label(self.shingles(words, k))


def label(h: np.ndarray) -> np.ndarray:
    """Shingles with their occurrences; ``h`` itself if all are different."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.r_[False, s[1:] == s[:-1]]
    if same.any():
        at = np.arange(len(h))
        start = np.maximum.accumulate(np.where(same, 0, at))
        again = np.empty(len(h), np.uint64)
        again[order] = (at - start).astype(np.uint64)
        h = np.where(again > 0, mix64(h + again * GOLD), h)
    return h


def folded(parts: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hashes of the rows of ``parts``, which depend on the order."""
    h = salt.copy()
    for column in parts.T:
        h = mix64(h * STEP ^ column)
    return h


def sketch(x: np.ndarray) -> np.ndarray:
    """Bucket keys of labelled shingles."""
    n, rows = len(x), max(1, (1 << 20) // len(x))
    take = min(SAMPLE, n)
    keys = []
    for at in range(0, SKETCHES, rows):
        seeds = SEEDS[at : at + rows]
        h = mix64(x ^ seeds[:, None])
        chosen = np.argpartition(h, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(seeds), 1))
        keys.append(folded(x[np.sort(chosen, axis=1)], seeds))
        if n <= SHORT and at < SHORT_SKETCHES:
            least = h.argmin(1)
            keys.append(mix64(x[least[: SHORT_SKETCHES - at]] ^ mix64(seeds[: SHORT_SKETCHES - at])))
    return np.concatenate(keys).view(np.int64)


def bitmap(x: np.ndarray) -> bytes:
    """Labelled shingles as bits of 64-bit words: a power of two of them, two bits a shingle at least."""
    size = max(64, 1 << (2 * len(x) - 1).bit_length())
    held = np.zeros(size, bool)
    held[x & np.uint64(size - 1)] = True
    return np.packbits(held, bitorder="little").tobytes()


def narrowed(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, as rows or one, of ``words`` 64-bit words: a bit stands for all that fall on it."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def needed(n, m):
    """The least length of an alignment of n and m shingles that links."""
    return np.ceil(THRESHOLD * (n + m) / (1 + THRESHOLD) - 1e-9)


def linkable(n, x: np.ndarray, m, y: np.ndarray) -> np.ndarray:
    """Whether sizes and bitmaps, rows or one, let a pair link: each lacks no more of the other than an alignment may skip."""
    words = min(x.shape[-1], y.shape[-1])
    x, y, need = narrowed(x, words), narrowed(y, words), needed(n, m)
    lack = lambda a, b: np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    return (np.minimum(n, m) >= need) & (lack(x, y) <= n - need) & (lack(y, x) <= m - need)


def chained(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """Whether ``need`` entries of x, which may repeat, equal entries of y in the same order.

    The longest common subsequence, a row of the table as the bits of a number: a bit is 0 where the length grows.  A match (i, j)
    of a chain that is long enough has j - (m - need) <= i <= j + n - need, so rows hold the columns of that band.
    """
    x, y = x[np.isin(x, y)], y[np.isin(y, x)]
    for _ in range(2):  # equal beginnings, then equal ends
        most = min(len(x), len(y))
        same = int(np.r_[x[:most] != y[:most], True].argmax())
        x, y, need = x[same:][::-1], y[same:][::-1], need - same
    n, m = len(x), len(y)
    if need <= 0 or min(n, m) < need:
        return need <= 0
    row, left, right, passed = 0, 0, 0, 0
    for at in range(0, m, ROWS):
        part = y[at : at + ROWS]
        lo, hi = max(0, at - (m - need)), min(n, at + len(part) + n - need)
        gone = lo - left
        passed += gone - (row & ((1 << gone) - 1)).bit_count()
        row = row >> gone | ((1 << (hi - right)) - 1) << (right - lo)
        left, right, full = lo, hi, (1 << (hi - lo)) - 1
        order = np.argsort(x[lo:hi], kind="stable")
        known = np.unique(part)
        first, end = (np.searchsorted(x[lo:hi], known, side, sorter=order) for side in ("left", "right"))
        masks = {}
        for v, a, b in zip(known.tolist(), first.tolist(), end.tolist(), strict=True):
            held = np.zeros(hi - lo, bool)
            held[order[a:b]] = True
            masks[v] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        for v in part.tolist():
            if hit := row & masks[v]:
                row = (row + hit | row - hit) & full
        length = passed + hi - lo - row.bit_count()
        if length >= need:
            return True
        if length + m - at - len(part) < need:
            return False
    return False


def aligned(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, plain: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """Whether the banded alignment of labelled shingles reaches the threshold, or else that of ``plain``, the same without labels."""
    n, m = len(x), len(y)
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if min(n, m) < need or not need:
        return False
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) < need:
        return False
    near = np.abs(i - j) <= n + m - 2 * need
    i, j = i[near], j[near]
    if len(i) >= need:
        j = j[np.argsort(i, kind="stable")]
        if (np.diff(j) > 0).all():
            return True
        ends: list[int] = []  # the longest rising chain
        for v in j.tolist():
            k = bisect_left(ends, v)
            ends[k : k + 1] = [v]
        if len(ends) >= need:
            return True
    return plain is not None and chained(*plain, need)


def alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """``aligned`` for two texts' shingles, each without and with labels."""
    return aligned(x[1], y[1], plain=(x[0], y[0]) if x[0] is not x[1] or y[0] is not y[1] else None)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SKETCHED; a text without a word has n = 0 and no keys."""
    shingler = Shingler()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows = []
            for doc, text_hash, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = shingler.words(text)
                if not len(words):
                    rows.append((doc, text_hash, 0, 0, 0, b"", np.empty(0, np.int64)))
                    continue
                c = np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), np.int64)
                x = shingler.labelled(words)
                rows.append((doc, text_hash, int(c[0]), int(c[1]), len(x), bitmap(x), sketch(x)))
            if rows:
                cols = [*zip(*rows, strict=True)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[6])]), pa.int32()), pa.array(np.concatenate(cols[6])))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols[:6], types, strict=True)), flat], ["doc_id", "text_hash", "c1", "c2", "n", "bits", "keys"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n_a, n_b, bits_a, bits_b) that can link."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        near = np.minimum(n, m) >= needed(n, m)
        for k in np.flatnonzero(near):
            x, y = (np.frombuffer(batch.column(c)[int(k)].as_buffer(), np.uint64) for c in (4, 5))
            near[k] = linkable(n[k], x, m[k], y)
        if near.any():
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) that align; texts of one a come together."""
    shingler = Shingler()
    last, x = None, None

    def both(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        h = shingler.shingles(shingler.words(text))
        return h, label(h)

    for batch in batches:
        good = []
        for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            if a != last:
                last, x = a, both(s.as_py())
            good.append(alike(x, both(t)))
        if any(good):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, text) of the wanted (uid): of the rows that hold a text one is taken, by its id and hash."""
    keyed = reps.select("uid", "rep", "text_hash").join(wanted, "uid")
    found = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    return found.join(keyed, ["rep", "text_hash"]).dropDuplicates(["uid"]).select("uid", "text")


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) that align, written."""
    side = lambda c: reps.select(F.col("uid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_plausible, "a long, b long")
    near = save(near)
    texts = save(_texts(docs, reps, near.select(F.col("a").alias("uid")).unionByName(near.select(F.col("b").alias("uid"))).distinct()))
    one, two = (texts.select(F.col("uid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = near.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    links = save(both.mapInArrow(_verify, "a long, b long"))
    discard(near, texts)
    return links


def band() -> Column:
    """The band of a size; bands are a little wider than the threshold, so only texts of one band or of adjacent bands can link."""
    return F.floor(F.log(F.col("n").cast("double")) / float(-1.001 * np.log(THRESHOLD))).cast("int")


def _blocks(rows: DataFrame, weight, most: int, columns: list[str], compare: Callable, schema: str, distinct: bool = False) -> DataFrame:
    """What ``compare`` makes, written, of (same, key, block_a, block_b): pairs of blocks of a bucket's rows (key, uid, component, n, …), about ``most`` of ``weight`` each.

    A block holds rows of one band of sizes and, where a component fills a block or more, of that component alone (``only``; -1
    for the others).  Pairs of blocks of one such component, and of bands that are not adjacent, are left out.
    """
    banded = rows.withColumn("band", band())
    sums = banded.groupBy("key", "band", "component").agg(F.sum(weight).alias("weight"))
    sums = save(sums.withColumn("only", F.when(F.col("weight") >= most, F.col("component")).otherwise(-1)))
    parts = sums.groupBy("key", "band", "only").agg(F.ceil(F.sum("weight") / most).cast("int").alias("parts"))
    placed = banded.join(sums.select("key", "band", "component", "only"), ["key", "band", "component"])
    dealt = placed.join(parts, ["key", "band", "only"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    by = ["key", "band", "only", "part"]
    blocks = save(dealt.repartition(*by).groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("block")).withColumn("id", F.monotonically_increasing_id()))
    heads = blocks.select("key", "band", "only", "id")
    one = heads.select("key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("band_a"), F.col("only").alias("only_a"), F.col("id").alias("a"))
    met = one.join(heads.select("key", "band", F.col("only").alias("only_b"), F.col("id").alias("b")), ["key", "band"])
    met = met.filter(((F.col("band") > F.col("band_a")) | (F.col("a") <= F.col("b"))) & ((F.col("only_a") < 0) | (F.col("only_a") != F.col("only_b"))))
    two = blocks.select(F.col("id").alias("b"), F.col("block").alias("block_b"))
    pairs = met.select("key", "a", "b").join(two, "b").join(blocks.select(F.col("id").alias("a"), F.col("block").alias("block_a")), "a").select((F.col("a") == F.col("b")).alias("same"), "key", "block_a", "block_b")
    found = pairs.mapInArrow(compare, schema)
    made = save(found.distinct() if distinct else found)
    discard(sums, blocks)
    return made


def _sides(batch: pa.RecordBatch, row: int) -> tuple:
    """(same, key, block, block) of a row of block pairs."""
    return (batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].values, batch.column(3)[row].values)


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, uid) of texts that have a partner of another component with which they can link."""
    for batch in batches:
        for row in range(batch.num_rows):
            _, key, *blocks = _sides(batch, row)
            (ra, ca, na, sa), (rb, cb, nb, sb) = ((*(x.field(k).to_numpy(zero_copy_only=False) for k in range(3)), [np.frombuffer(v, np.uint64) for v in x.field(3).to_pylist()]) for x in blocks)
            hit_a, hit_b = np.zeros(len(ra), bool), np.zeros(len(rb), bool)
            widths = np.array([len(v) for v in sb])
            groups = [(at, np.stack([sb[k] for k in at])) for at in (np.flatnonzero(widths == w) for w in np.unique(widths))]
            for i in range(len(ra)):
                for at, bits in groups:
                    some = (cb[at] != ca[i]) & (np.minimum(na[i], nb[at]) >= needed(na[i], nb[at]))
                    if some.any():
                        at = at[some]
                        good = at[linkable(na[i], sa[i], nb[at], bits[some])]
                        if len(good):
                            hit_a[i] = hit_b[good] = True
            found = np.unique(np.concatenate([ra[hit_a], rb[hit_b]]))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], ["key", "uid"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = [shingler.shingles(shingler.words(t)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["uid", "x"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest (a, b) of the links between texts of different components of two blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            same, _, *blocks = _sides(batch, row)
            (ra, ca, ha), (rb, cb, hb) = ((x.field(0).to_numpy(), x.field(1).to_numpy(), [np.frombuffer(v, np.uint64) for v in x.field(2).to_pylist()]) for x in blocks)
            xa, xb = [label(v) for v in ha], [label(v) for v in hb]
            sizes = np.array([len(v) for v in xb])
            known, ids = np.unique(np.concatenate(xb), return_inverse=True)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            held = np.zeros(len(known) + 1, bool)
            pairs: list[tuple[int, int]] = []
            root: dict[int, int] = {}

            def top(k: int, root=root) -> int:
                while (up := root.get(k, k)) != k:
                    k = up
                return k

            for i, x in enumerate(xa):
                n = len(x)
                rows = np.flatnonzero((cb != ca[i]) & (np.minimum(n, sizes) >= needed(n, sizes)) & ((rb > ra[i]) if same else True))
                if not len(rows):
                    continue
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                mine = at[known[at] == x]
                held[mine] = True
                common = np.add.reduceat(held[ids].astype(np.int32), starts)[rows]
                held[mine] = False
                for j in rows[common >= needed(n, sizes[rows])]:
                    u, v = top(int(ca[i])), top(int(cb[j]))
                    if u != v and alike((ha[i], x), (hb[j], xb[j])):
                        root[max(u, v)] = min(u, v)
                        pairs.append((int(ra[i]), int(rb[j])))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], ["a", "b"])


def _settled(docs: DataFrame, reps: DataFrame, open_: DataFrame) -> DataFrame:
    """Links between the components of buckets (key, uid, component) that hold several."""
    facts = open_.join(reps.select("uid", "n", "bits"), "uid")
    weight = 1 + F.floor(F.octet_length("bits") / UNIT)
    some = _blocks(facts, weight, BLOCK, ["uid", "component", "n", "bits"], _partners, "key long, uid long", distinct=True)
    arrays = save(_texts(docs, reps, some.select("uid").distinct()).mapInArrow(_shingle_rows, "uid long, x binary"))
    rows = open_.join(some, ["key", "uid"]).join(arrays, "uid").withColumn("n", (F.octet_length("x") / 8).cast("int"))
    links = _blocks(rows, F.col("n"), BLOCK_SHINGLES, ["uid", "component", "x"], _block_links, "a long, b long")
    discard(some, arrays)
    return links


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, first) of each row that has an id; class_id is equal for near-duplicates: the smallest id of the class.

    ``text_hash`` is xxhash64 of the text, ``first`` whether the row's id and text are those that its class keeps; it is null for
    texts without a word.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").filter("doc_id is not null")
    sketched = save(texts.mapInArrow(_sketches, SKETCHED))
    worded = sketched.filter("n > 0")
    best = F.min(F.struct("doc_id", "text_hash", "n", "bits", "keys")).alias("r")
    reps = save(worded.groupBy("c1", "c2").agg(best).selectExpr("monotonically_increasing_id() uid", "c1", "c2", "r.doc_id rep", "r.text_hash text_hash", "r.n n", "r.bits bits", "r.keys keys"))
    rows = save(worded.select("doc_id", "text_hash", "c1", "c2").join(reps.select("c1", "c2", "uid"), ["c1", "c2"]).select("doc_id", "text_hash", "uid"))
    wordless = save(sketched.filter("n = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(None).cast("boolean").alias("first")))
    discard(sketched)
    members = reps.select("uid", F.explode("keys").alias("key")).distinct()
    buckets = save(members.groupBy("key").agg(F.min("uid").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    held = save(members.join(buckets, "key").select("key", "uid", "leader", "size"))
    discard(buckets)
    links = _links(docs, reps, held.filter("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")))
    # ids that hold several texts hold them together
    several = save(rows.groupBy("doc_id").agg(F.min("uid").alias("a"), F.max("uid").alias("z")).filter("a < z").select("doc_id", "a"))
    if not several.isEmpty():
        verified, links = links, save(links.unionByName(rows.join(several, "doc_id").filter("uid <> a").select("a", F.col("uid").alias("b")).distinct()))
        discard(verified)
    # buckets of two are settled; of larger ones those that hold several components are not
    label = save(components(links))
    placed = held.filter("size > 2").join(label.withColumnRenamed("id", "uid"), "uid", "left").select("key", "uid", F.coalesce("component", "uid").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    open_ = save(placed.join(mixed, "key"))
    if not open_.isEmpty():  # what is known already goes on as a star of each component
        settled, star = _settled(docs, reps, open_), label
        label = save(components(star.toDF("a", "b").unionByName(settled)))
        discard(settled, star)
    # the smallest id of each class and, of its texts, the one with the smallest hash
    linked = reps.select("uid", "rep", "text_hash").join(label.withColumnRenamed("id", "uid"), "uid")
    heads = linked.groupBy("component").agg(F.min(F.struct("rep", "text_hash")).alias("head"))
    known = save(label.join(heads, "component").select(F.col("id").alias("uid"), "head"))
    final = reps.select("uid", F.struct("rep", "text_hash").alias("own")).join(known, "uid", "left").select("uid", F.coalesce("head", "own").alias("head"))
    own = F.struct(F.col("doc_id").alias("rep"), "text_hash")
    final = save(final)
    discard(reps, held, links, label, several, open_, known)
    found = rows.join(final, "uid").select("doc_id", "text_hash", F.col("head.rep").alias("class_id"), (own == F.col("head")).alias("first"))
    return found.unionByName(wordless)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of each row of ``docs``."""
    none = F.lit(None).cast("long")
    nameless = docs.filter(F.col("doc_id").cast("long").isNull()).select(none.alias("doc_id"), none.alias("class_id"))
    return classes(docs).select("doc_id", "class_id").unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns: of each class one row, that with the smallest id; rows without a word or an id stay."""
    doc, hash_, keep, alone, rank = unused(docs, "_doc", "_hash", "_keep", "_alone", "_rank")
    verdict = classes(docs).filter("first is not null").groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_)).agg(F.max("first").alias(keep))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), hash_: F.xxhash64("text")})
    joined = keyed.join(verdict, [doc, hash_], "left").filter(F.coalesce(keep, F.lit(True)))
    # rows that stay whatever their like count one by one; the rank needs no further shuffle
    joined = joined.withColumn(alone, F.when(F.col(keep).isNull(), F.monotonically_increasing_id()))
    ranked = joined.withColumn(rank, F.row_number().over(Window.partitionBy(doc, hash_, alone).orderBy(doc))).filter(F.col(rank) == 1)
    return ranked.select(*[quoted(n) for n in docs.columns])
