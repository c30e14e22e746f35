"""Best-fit packing of token sequences: patterns fitted to the length histogram by non-negative least squares.

Documents become pieces of MOST tokens or fewer.  All planning works on the histogram of piece lengths,
which has MOST entries whatever the corpus.  Patterns are the multisets of up to four lengths that fill a sequence.  All of them are
enumerated in each round, by array arithmetic on the part of the histogram that is not yet met; of those that reduce
it, the best for each length become columns of the least squares, for ROUNDS rounds or until no pattern outside would reduce it by
TOLERANCE of the pieces.  The fitted repeat counts are rounded down and the residual is packed by best fit, decreasing, on counts.  Rounding can leave
a residual that packs badly; then a growing share of every pattern's repeats is given to it, until the plan needs no
more sequences than best fit alone would.
The plan is a list of runs "pieces of length l with ranks from..to, in sequences from s on, at offset o".

A piece's rank among those of its length is the count in earlier partitions plus its place in its own, both found in the
pass that tokenizes, so no key is ever gathered in one task.

Defined results: a null or empty text is one piece that holds id 0 only; a null doc_id stays null; repeated rows are packed as
rows of their own; an empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

MOST = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: A worker keeps the ids of so many words.
CACHE_WORDS = 150_000
#: The least squares end when no pattern reduces the squared error by more than this share of the pieces.
TOLERANCE, SWEEPS, ROUNDS = 1e-3, 8, 10
#: Shares of the patterns' repeats that are given to the residual, one after the other; the last is all.
RELEASED = (0.0, 1 / 256, 1 / 64, 1 / 16, 1 / 4, 1.0)


#: Pieces of texts, the same for ASCII, and for texts in which Python's own classes of characters agree with Unicode's categories.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_SPLIT = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
NOT_PLAIN = re.compile("[^\0-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pieces(dict):
    """Ids of pieces as bytes, encoded when first asked for; ASCII ones by ``single``, which is not asked to split them again."""

    def __init__(self, encode: Callable[[str], list[int]], single: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode, self.single = encode, single

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = little_endian(self.single(piece.encode()) if piece.isascii() else self.encode(piece))
        return ids


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    A byte-level BPE never merges across the pieces of its pre-tokenizer, so ids are kept by piece.  New pieces are
    encoded by rank, which is the same where ids follow the order of merges.  Files of
    other kinds, and texts that hold the string of a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        vocab = model.get("vocab") or {}
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges") or []]
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
            and all(x < y for x, y in zip(merged, merged[1:], strict=False)) and bool(merged) and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges"))
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile(SPLIT).findall
        if self.by_piece:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
            ranks = {bytes(letter[c] for c in token): n for token, n in vocab.items() if token not in self.special}
            encoding = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.kept = Pieces(encoding.encode_ordinary, encoding._core_bpe.encode_single_piece)

    @cached_property
    def whole(self):
        """The tokenizer itself, read when the first text goes to it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(t in text for t in self.special):
            return self._encode(text)
        words = ASCII_SPLIT(text) if text.isascii() else self.split(text) if NOT_PLAIN(text) else PLAIN_SPLIT(text)
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, words))


def cut(n: int, most: int = MOST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first may be shorter than ``most``."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, tokenizer: str, most: int = MOST) -> DataFrame:
    """The pieces of all documents, written to the shared folder; nth is the rank among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = WordTokenizer(tokenizer).encode, Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                for k, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES))


Plan = list[tuple[tuple[int, ...], int]]  # (lengths of a sequence's pieces, repeats)


def best_fit(histogram: dict[int, int], most: int = MOST) -> Plan:
    """Best fit, decreasing, for all pieces of a length at once: sequences with equal contents are one entry with a count."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: Plan = []

    def put(left: int, content: tuple[int, ...], n: int) -> None:
        if left:
            room.setdefault(left, []).append((content, n))
        else:
            done.append((content, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            left = min((r for r in room if r >= length), default=None)
            if left is None:
                break
            content, have = room[left].pop()
            used = min(n, have)
            if have > used:
                room[left].append((content, have - used))
            if not room[left]:
                del room[left]
            put(left - length, (*content, length), used)
            n -= used
        if n:  # new sequences, each filled with this length as far as it goes
            each = most // length
            full, rest = divmod(n, each)
            if full:
                put(most - each * length, (length,) * each, full)
            if rest:
                put(most - rest * length, (length,) * rest, 1)
    return done + [x for xs in room.values() for x in xs]


def best_patterns(worth: np.ndarray, most: int = MOST) -> dict[tuple[int, ...], float]:
    """Of all patterns of one to four lengths that sum to ``most``, the one worth most for each length, as {pattern: worth}.

    ``worth`` holds a number for each length 0 … most, -inf for lengths that there are none of.
    """
    at = np.arange(most + 1)
    found: dict[tuple[int, ...], float] = {}

    def add(parts: list[np.ndarray], value: np.ndarray) -> None:
        good = np.flatnonzero(value > 0)
        for *lengths, v in zip(*(x[good].tolist() for x in parts), value[good].tolist(), strict=True):
            found[tuple(sorted(lengths, reverse=True))] = v

    add([at[most:]], worth[most:])
    add([at[1:most], most - at[1:most]], worth[1:most] + worth[most - at[1:most]])
    # pair[s] is the most that two lengths of sum s are worth, half[s] the first of them
    pair, half = np.full(most + 1, -np.inf), np.zeros(most + 1, np.int64)
    for s in range(2, most + 1):
        sums = worth[1 : s // 2 + 1] + worth[s - 1 : s - s // 2 - 1 : -1]
        k = int(sums.argmax())
        pair[s], half[s] = sums[k], k + 1
    a = at[1 : most - 1]
    rest = most - a
    add([a, half[rest], rest - half[rest]], worth[a] + pair[rest])
    s = at[2 : most - 1]
    add([half[s], s - half[s], half[most - s], most - s - half[most - s]], pair[s] + pair[most - s])
    return found


def fit_repeats(histogram: dict[int, int], most: int = MOST) -> tuple[list[tuple[int, ...]], list[float]]:
    """Patterns and repeats x >= 0 that bring sum(x * pattern) near the histogram: least squares by coordinate descent, with columns
    added as they are worth it."""
    residual = {n: float(c) for n, c in histogram.items()}
    enough = TOLERANCE * sum(histogram.values())
    pool: dict[tuple[int, ...], int] = {}
    columns, norms, x = [], [], []
    for _ in range(ROUNDS):
        worth = np.full(most + 1, -np.inf)
        worth[list(residual)] = list(residual.values())
        gains = {p: v * v / sum(m * m for m in Counter(p).values()) for p, v in best_patterns(worth, most).items() if p not in pool}
        new = [p for p, g in sorted(gains.items(), key=lambda e: (-e[1], e[0])) if g > enough]
        for p in new:
            pool[p] = len(columns)
            columns.append([*Counter(p).items()])
            norms.append(float(sum(m * m for _, m in columns[-1])))
            x.append(0.0)
        moved = 0.0
        for _ in range(SWEEPS):
            moved = 0.0
            for j, col in enumerate(columns):
                d = max(-x[j], sum(m * residual[n] for n, m in col) / norms[j])
                if d:
                    x[j] += d
                    for n, m in col:
                        residual[n] -= m * d
                    moved += abs(d)
            if moved < TOLERANCE * max(1, len(columns)):
                break
        if not new and moved < TOLERANCE * max(1, len(columns)):
            break
    return [*pool], x


def rounded(pool: list[tuple[int, ...]], fitted: list[float], histogram: dict[int, int], released: float) -> tuple[Plan, dict[int, int]]:
    """Whole repeats of the patterns, less the share ``released``, and what is left of the histogram."""
    left, out = dict(histogram), []
    for j in sorted(range(len(pool)), key=lambda j: (-fitted[j], pool[j])):
        need = Counter(pool[j])
        times = min(int(fitted[j] * (1 - released)), *(left[n] // m for n, m in need.items()))
        if times > 0:
            out.append((pool[j], times))
            for n, m in need.items():
                left[n] -= m * times
    return out, {n: c for n, c in left.items() if c}


def sequences(planned: Plan) -> int:
    return sum(n for _, n in planned)


def plan(histogram: dict[int, int], most: int = MOST) -> Plan:
    """Patterns with whole repeat counts, then best fit of what is left."""
    goal = sequences(best_fit(histogram, most))
    pool, fitted = fit_repeats(histogram, most)
    for released in RELEASED:
        out, left = rounded(pool, fitted, histogram, released)
        out += best_fit(left, most)
        if sequences(out) <= goal:
            break
    return out


def runs(planned: Plan) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset), sorted by length and rank."""
    rows, at, sequence = [], Counter(), 0
    for content, n in planned:
        offset = 0
        for length in content:
            rows.append((length, at[length], n, sequence, offset))
            at[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, most: int = MOST) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cutup = pieces(docs, tokenizer, most)
    counts = cutup.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))  # MOST rows a partition at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # MOST rows at most
    table = docs.sparkSession.sparkContext.broadcast(runs(plan(histogram, most)))  # its size depends on MOST, not on the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        keys = known[:, 0] << 44 | known[:, 1] if len(known) else np.empty(0, np.int64)
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = known[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cutup.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
