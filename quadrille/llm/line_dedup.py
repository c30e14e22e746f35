"""Line dedup: hashes of lines, range-partitioned and sorted by document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case.
Keys of at least MIN_CHARS code points that at least MIN_DOCS documents hold lose their lines
except in the largest document.  Only 128-bit hashes, ids and positions are shuffled.

The range boundaries are on (hash, document): a key that a third of the corpus holds spans many
partitions.  Each partition streams its keys; whatever the other partitions hold, every
document but the last it sees of a key with MIN_DOCS documents is a drop.  Only the first and the last
key of a partition can reach into a neighbour; of these it holds MIN_DOCS documents back at most,
which a small aggregation settles.

Defined results: a null or empty text is one empty line; null ids count as one document, smaller
than all others; rows with equal id and text share their bitmap; an empty table gives no rows.
Further columns of the input, of any name, are ignored by ``keep_bitmaps`` and kept by ``drop_lines``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, quoted, save, unused

MIN_CHARS, MIN_DOCS = 20, 3
WHITE = b" \t\n\x0b\x0c\r"
KEYS = "h1 long, h2 long, doc_id long, text_hash long, positions array<int>"
STREAM = KEYS + ", n_docs int, kind int"
DROP, PENDING, STATS = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _line_hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            found: dict[bytes, list[int]] = {}
            for k, line in enumerate(text.split(b"\n")):
                key = line.strip(WHITE).lower()
                if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                    found.setdefault(xxhash.xxh3_128_digest(key), []).append(k)
            rows += [(digest, doc, text_hash, at) for digest, at in found.items()]
        if rows:
            halves = np.frombuffer(b"".join(r[0] for r in rows), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                ["h1", "h2", "doc_id", "text_hash", "positions"],
            )


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted by hash and document.  ``held`` are the rows that no later row has yet made drops."""
    out: list[tuple] = []
    key, n, last, held, first = None, 0, None, [], True

    def undecided() -> None:
        out.extend((*key, *row, n, PENDING) for row in held)
        out.append((*key, last, None, None, n, STATS))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["h1", "h2", "doc_id", "text_hash", "positions", "n_docs", "kind"])
        out.clear()
        return made

    for batch in batches:
        for h1, h2, doc, text_hash, at in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if key != (h1, h2):
                if key is not None and first:
                    undecided()
                    first = False
                key, n, held = (h1, h2), 0, []
            if not n or doc != last:
                n, last = n + 1, doc
                if n >= min_docs:
                    out.extend((*key, *row, n, DROP) for row in held)
                    held = []
            held.append((doc, text_hash, at))
        if len(out) >= 4096:
            yield flush()
    if key is not None:
        undecided()
    if out:
        yield flush()


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, positions): the lines to drop, in rows for each key and document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").filter("text is not null")
    keys = save(texts.mapInArrow(lambda it: _line_hashes(it, min_chars), KEYS))  # the ranges are sampled from it, then it is read
    spread = keys.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id")
    streamed = save(spread.mapInArrow(lambda it: _stream(it, min_docs), STREAM))
    discard(keys)
    decided = streamed.filter(F.col("kind") == DROP).select("doc_id", "text_hash", "positions")
    whole = (
        streamed.filter(F.col("kind") == STATS).groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("in_docs"), F.max("doc_id").alias("largest"))
        .filter(F.col("in_docs") >= min_docs)
    )
    rest = (
        streamed.filter(F.col("kind") == PENDING).join(whole, ["h1", "h2"])
        .filter(F.col("doc_id").isNull() & F.col("largest").isNotNull() | (F.col("doc_id") < F.col("largest")))
        .select("doc_id", "text_hash", "positions")
    )
    return decided.unionByName(rest)


def pack_bitmap(dropped: list[int]) -> bytes:
    """Bits of the lines up to the last one dropped, padded with ones: 1 for those that stay; lines beyond stay."""
    keep = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def dropped_lines(bitmap: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)) == 0)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for lists in batch.column(2).to_pylist():
            maps.append(pack_bitmap(sorted({k for part in lists for k in part})))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, bitmap): zlib-compressed keep bits, for documents that lose lines only."""
    grouped = dropped_positions(docs, min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_list("positions").alias("lists"))
    return grouped.mapInArrow(_bitmaps, "doc_id long, text_hash long, bitmap binary")


def _split_kept(text: bytes | None, bitmap: bytes | None) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    if bitmap is None:
        return len(lines), 0, text or b""
    drop = set(dropped_lines(bitmap).tolist())
    return len(lines), len(drop), b"\n".join(line for k, line in enumerate(lines) if k not in drop)


def with_bitmaps(docs: DataFrame, bitmap: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with a column ``bitmap`` that is null where every line stays."""
    doc, hash_ = unused(docs, "_doc", "_hash")
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_), F.col("bitmap").alias(bitmap))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(hash_))
    return docs.join(maps, on, "left").select(*[docs[quoted(c)] for c in docs.columns], quoted(bitmap))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its columns, without the lines to drop; n_chars, if there, follows the text."""
    (bitmap_,) = unused(docs, "_bitmap")
    joined = with_bitmaps(docs, bitmap_, min_chars, min_docs)
    schema = docs.schema
    at, names = schema.names.index("text"), [*schema.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, bitmap in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                texts.append(text if bitmap is None else _split_kept(text.encode(), bitmap)[2].decode())
            cols = [batch.column(k) for k in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = numbered(joined).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_split_kept(t, b) for t, b in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got])],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    joined = with_bitmaps(docs.select("doc_id", "text"), "bitmap", min_chars, min_docs)
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "bitmap").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
