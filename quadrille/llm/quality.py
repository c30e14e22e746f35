"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of the learned vectors of its features: its words, the
character n-grams of its words (ends marked), and its word pairs, each hashed into BUCKETS rows; a softmax layer follows.  Besides, a word
that stands one, two or three places before too is written as a back reference, a word n-gram without its words: pairs alone teach
nothing about repeats of words that no training text repeats.  As nothing
non-linear lies between, scoring needs one number a feature, and a worker keeps the sums of words it has seen.

The classifier is fitted on FIT_ROWS rows or fewer of each label, chosen by the hash of the id among
the labelled rows outside the held-out fold; texts of any length are counted where they are read, and weigh alike.  Training weighs
the labels back to their share.

Defined results: null and empty texts, and texts of white space only, get the share of label 1 as score; without any
training rows every score is 0.5; with a single label it is that label's smoothed share.  Repeated rows get the same score.
Further columns, of any name, are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen_by, fold, mix64, ngram_hashes, numbered, sample_threshold

BUCKETS, DIM, NGRAMS = 1 << 15, 12, (2, 3, 4)
FIT_ROWS = 1000
EPOCHS, MIN_STEPS, BATCH, RATE = 8, 400, 48, 25.0
THRESHOLD, HELD_OUT = 0.3, 5
CACHE_WORDS, LONG_WORD = 150_000, 64
PAIR = np.uint64(0x9E3779B97F4A7C15)


def hash_word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def feature_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of the words' n-grams and of the words themselves, and the words' hashes."""
    owner, bucket = ngram_hashes(words, NGRAMS, BUCKETS)
    whole = np.array([hash_word(w) for w in words], np.uint64)
    return np.concatenate([owner, np.arange(len(words))]), np.concatenate([bucket, (whole % np.uint64(BUCKETS)).astype(np.int64)]), whole


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """The buckets of each word and its successor, from the words' hashes in order."""
    return (mix64(hashes[:-1] * PAIR + hashes[1:]) % np.uint64(BUCKETS)).astype(np.int64)


#: The buckets of the back references; no word has a space in it.
BACK = [hash_word(f" back {k}") % BUCKETS for k in (1, 2, 3)]


def repeats(hashes: np.ndarray) -> np.ndarray:
    """How many words equal that one, two and three places before."""
    return np.array([np.count_nonzero(hashes[k:] == hashes[:-k]) for k in (1, 2, 3)], float)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, mean counts) of a text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts = Counter(words)
    owner, bucket, whole = feature_hashes([*counts])
    out = np.bincount(bucket, np.fromiter(counts.values(), float)[owner], BUCKETS)
    number = {w: k for k, w in enumerate(counts)}
    order = whole[[number[w] for w in words]]
    out += np.bincount(pair_buckets(order), minlength=BUCKETS)
    np.add.at(out, BACK, repeats(order))
    at = np.flatnonzero(out)
    return at.astype(np.int32), (out[at] / out.sum()).astype(np.float32)


class Model:
    """What scoring needs: a log-odds weight of each bucket and the bias."""

    def __init__(self, weights: np.ndarray, bias: float, empty: float):
        self.weights, self.bias, self.empty = weights, bias, empty
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.sums, self.sizes, self.hashes = np.empty(CACHE_WORDS), np.empty(CACHE_WORDS), np.empty(CACHE_WORDS, np.uint64)

    def state(self):
        return self.weights, self.bias, self.empty

    def _learn(self, words: list[str]) -> None:
        """Add words, in parts of bounded length."""
        while words:
            part, size = [], 0
            while words and size <= 1 << 18:
                part.append(words.pop())
                size += len(part[-1])
            owner, bucket, whole = feature_hashes(part)
            rows = slice(len(self.at), len(self.at) + len(part))
            if rows.stop > len(self.sums):
                grown = 2 * rows.stop
                self.sums, self.sizes, self.hashes = (np.concatenate([x, np.empty(grown - len(x), x.dtype)]) for x in (self.sums, self.sizes, self.hashes))
            self.sums[rows] = np.bincount(owner, self.weights[bucket], len(part))
            self.sizes[rows] = np.bincount(owner, minlength=len(part))
            self.hashes[rows] = whole
            self.at.update(zip(part, range(rows.start, rows.stop), strict=True))

    def score(self, texts: list[str | None]) -> list[float]:
        out, back = [], self.weights[BACK].astype(float)
        for text in texts:
            words = (text or "").split()
            if not words:
                out.append(self.empty)
                continue
            new = set(words).difference(self.at)
            if len(self.at) + len(new) > CACHE_WORDS and self.at:
                self._reset()
                new = set(words)
            self._learn(sorted(new))
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            order = self.hashes[at]
            pairs, again = self.weights[pair_buckets(order)], repeats(order)
            mean = (self.sums[at].sum() + pairs.sum(dtype=float) + back @ again) / (self.sizes[at].sum() + len(pairs) + again.sum())
            out.append(float(1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40)))))
            if new and max(map(len, new)) > LONG_WORD:
                self._reset()  # long words are not kept
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float, seed: int = 5) -> Model:
    """SGD without momentum on sparse features; ``prior`` is label 1's share, to which the sample is weighed back."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))), prior)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.log(np.array([1 - prior, prior], np.float32))
    out[:, 1] = rng.uniform(-1, 1, DIM)
    out[:, 0] = -out[:, 1]
    share = y.mean()
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    batches = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            chosen = order[start : start + BATCH]
            at, place = np.unique(np.concatenate([rows[k][0] for k in chosen]), return_inverse=True)
            dense = np.zeros((len(chosen), len(at)), np.float32)
            dense[np.repeat(np.arange(len(chosen)), [len(rows[k][0]) for k in chosen]), place] = np.concatenate([rows[k][1] for k in chosen])
            hidden = dense @ emb[at]
            logits = hidden @ out + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen].astype(int)] -= 1
            p *= (weight[chosen] / len(chosen))[:, None]
            rate = RATE * (1 - step / steps)
            grad_hidden = p @ out.T
            out -= rate * 0.05 * (hidden.T @ p)
            bias -= rate * 0.005 * p.sum(0)
            emb[at] -= rate * (dense.T @ grad_hidden)
            step += 1
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], ["id", "y", "at", "n"])


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows outside fold 0 of ``held_out``, or on all labelled rows if that is None."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    if held_out:
        known = known.filter(fold("id", held_out) != 0)
    limits = sample_threshold(known, F.col("y"), fit_rows)
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    widest = {0: max(limits.values(), default=0)}  # before the join, so that few texts are shuffled
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text <> ''").filter(chosen_by(widest, F.lit(0), F.col("id")))
    chosen = own.join(known.filter(chosen_by(limits, F.col("y"), F.col("id"))), "id").select("id", "y", "text")
    sparse = chosen.mapInArrow(_featured, "id long, y int, at binary, n binary").limit(4 * fit_rows)
    rows = sorted((r.id, r.y, bytes(r.at), bytes(r.n)) for r in sparse.collect())  # BUCKETS numbers a row at most
    return fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], [r[1] for r in rows], prior)


def score(docs: DataFrame, model: Model, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            got = np.array(model.score(batch.column(2).to_pylist()), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", held_out) == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with its columns, without the rows that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            good = np.array(model.score(batch.column(at).to_pylist()), float) >= threshold
            if good.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good)).columns, names)

    return numbered(docs).mapInArrow(run, docs.schema)
