"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic examples are the positives; unlabelled text, toxic or not, is the rest.  The risk estimator
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` is corrected by the class prior and kept non-negative: where the
bracket falls below zero, the step goes the other way, against the overfitting it shows.

Features are the presence of words (letters and digits, lower case), and of beginnings and ends of words, that stand out among
positives: at least MIN_DF of them hold it, at a rate that is z standard deviations above the unlabelled.  Beginnings and ends
let inflected and compound forms count that no training text holds.  A text is scored whole, by the features it holds.

The classifier is fitted on FIT_POSITIVE and FIT_UNLABELLED rows at most, chosen by the hash of
the id outside the held-out fold, whatever their length; the prior is the share of label 1 among the labelled rows outside that fold.
Of the levels ZS that one is taken whose classifiers, each fitted without one of CHECKS parts of these rows, have the best F1 on the labelled rows of
those parts, none of which is held out.  The final fit takes all rows.

Defined results: null and empty texts get the score of a text without any telling word; without positives every
score is the prior.  Repeated rows get the same score.  Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen_by, fold, sample_threshold

FIT_POSITIVE, FIT_UNLABELLED, FIT_NEGATIVE = 1500, 3000, 1500
MIN_DF, ZS, MOST_WORDS = 3, (10.0, 8.0, 6.0, 4.0, 2.0), 2048
#: Parts of the cross-validation that chooses among ZS.
CHECKS = 4
EPOCHS, RATE, L2, BATCH = 60, 0.5, 1e-3, 256
THRESHOLD, HELD_OUT = 0.3, 4
#: Lengths of the beginnings and ends of words.
AFFIXES = (4, 5, 6)
CACHE_WORDS, LONG_WORD = 200_000, 64
WORDS = re.compile(r"[^\W_]+").findall


def parts_of(word: str) -> list[str]:
    """A word, and its beginnings and ends, which a sign that no word holds marks."""
    return [word, *(x for k in AFFIXES if len(word) > k for x in (word[:k] + "-", "-" + word[-k:]))]


class Vocabulary:
    """Numbers of features; each different word is taken apart once."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.of_word: dict[str, list[int]] = {}

    def encode(self, words: list[str]) -> np.ndarray:
        """The different features of the words, as numbers that rise."""
        for w in words:
            if w not in self.of_word:
                self.of_word[w] = [self.number.setdefault(x, len(self.number)) for x in parts_of(w)]
        return np.unique(np.fromiter((k for w in words for k in self.of_word[w]), np.int32))

    def names(self) -> list[str]:
        return [*self.number]


def telling_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str], least: float) -> list[int]:
    """Features of positives that are ``least`` standard deviations more frequent there, the clearest first."""
    count = lambda rows: np.bincount(np.concatenate([np.empty(0, np.int32), *rows]), minlength=len(names))
    p, u = count(positive), count(unlabelled)
    rate = (u + 0.5) / (len(unlabelled) + 1)
    z = (p / len(positive) - rate) / np.sqrt(rate * (1 - rate) * (1 / len(positive) + 1 / max(1, len(unlabelled))) + 1e-300)
    good = np.flatnonzero((p >= MIN_DF) & (z >= least))
    return sorted(good.tolist(), key=lambda k: (-z[k], names[k]))[:MOST_WORDS]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str], prior: float, least: float = ZS[0], seed: int = 3) -> tuple[dict[str, float], float]:
    """Weights of features and the bias, by minibatch nnPU with the logistic loss, from rows of feature numbers."""
    chosen = telling_features(positive, unlabelled, names, least) if positive else []
    if not chosen:
        return {}, float(np.log(prior / (1 - prior)))
    column = np.full(len(names), -1)
    column[chosen] = np.arange(len(chosen))

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen) + 1), np.float32)
        out[:, -1] = 1
        for k, row in enumerate(rows):
            at = column[row]
            out[k, at[at >= 0]] = 1
        return out

    xp, xu = dense(positive), dense(unlabelled)
    w = np.zeros(xp.shape[1], np.float64)
    w[-1] = np.log(prior / (1 - prior))
    speed = np.full_like(w, 1e-6)
    rng = np.random.default_rng(seed)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, -z)  # noqa: E731  of a margin
    steps = max(1, len(xu) // BATCH)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(xu)), steps):
            bp = xp[rng.integers(0, len(xp), min(len(xp), BATCH))]
            bu = xu[rows]
            now = w.astype(np.float32)
            zp, zu = bp @ now, bu @ now
            risk_minus = loss(-zu).mean() - prior * loss(-zp).mean()
            minus = bu.T @ sig(zu) / len(bu) - prior * (bp.T @ sig(zp)) / len(bp)
            grad = minus - prior * (bp.T @ sig(-zp)) / len(bp) if risk_minus >= 0 else -minus
            grad[:-1] += L2 * w[:-1]
            speed += grad * grad
            w -= RATE * grad / np.sqrt(speed)
    return {names[x]: float(w[k]) for k, x in enumerate(chosen)}, float(w[-1])


Sample = list[tuple[int, np.ndarray]]  # (id, feature numbers)


def chosen_level(positive: Sample, unlabelled: Sample, negative: Sample, names: list[str], prior: float) -> float:
    """The level of ZS with the best F1 at THRESHOLD over all CHECKS parts, each scored without having been fitted on, weighed back to the prior."""
    part = lambda doc: zlib.crc32(f"{doc}/check".encode()) % CHECKS
    number = {n: k for k, n in enumerate(names)}
    edge = np.log(THRESHOLD / (1 - THRESHOLD))
    best, level = -1.0, ZS[0]
    for z in ZS:
        hits: list[bool] = []
        wrongs: list[bool] = []
        for k in range(CHECKS):
            own, rest = ([x for d, x in rows if part(d) != k] for rows in (positive, unlabelled))
            if not own or not rest:
                continue
            weights, bias = fit(own, rest, names, prior, z)
            each = np.zeros(len(names))
            each[[number[n] for n in weights]] = [*weights.values()]
            for rows, seen in ((positive, hits), (negative, wrongs)):
                seen += [each[x].sum() + bias >= edge for d, x in rows if part(d) == k]
        if not hits or not wrongs:
            continue
        hit, wrong = np.mean(hits), np.mean(wrongs)
        f1 = 2 * prior * hit / (prior + prior * hit + (1 - prior) * wrong)
        if f1 > best + 1e-9:
            best, level = f1, z
    return level


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(sorted(set(WORDS((t or "").lower())))) for t in batch.column(1).to_pylist()])], ["id", "words"])


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT) -> tuple[dict[str, float], float]:
    """Fit on rows outside fold 2 of ``held_out``, or on all rows if that is None.  The driver gets the different words of the sample's texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text <> '' and id is not null")
    if held_out:
        known, own = known.filter(fold("id", held_out) != 2), own.filter(fold("id", held_out) != 2)
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    prior = min(0.9, (shares.get(1, 0) + 1) / (sum(shares.values()) + 2))
    limits = {y: sample_threshold(known, F.col("y"), most).get(y, 0) for y, most in ((1, FIT_POSITIVE), (0, FIT_NEGATIVE))}
    widest = chosen_by({0: max(limits.values())}, F.lit(0), F.col("id"))  # before the join, so that few texts are shuffled

    vocabulary = Vocabulary()

    def sample(rows: DataFrame, most: int) -> Sample:
        found = rows.select("id", "text").mapInArrow(_words, "id long, words string").limit(2 * most).collect()
        return [(r.id, vocabulary.encode(r.words.split())) for r in sorted(found)]

    labelled = own.filter(widest).join(known.filter(chosen_by(limits, F.col("y"), F.col("id"))), "id")
    positive, negative = (sample(labelled.filter(F.col("y") == y), most) for y, most in ((1, FIT_POSITIVE), (0, FIT_NEGATIVE)))
    limit = sample_threshold(own, F.lit(0), FIT_UNLABELLED)
    unlabelled = sample(own.filter(chosen_by(limit, F.lit(0), F.col("id"))), FIT_UNLABELLED)
    names = vocabulary.names()
    level = chosen_level(positive, unlabelled, negative, names, prior) if positive else ZS[0]
    return fit([x for _, x in positive], [x for _, x in unlabelled], names, prior, level)


def score(docs: DataFrame, model: tuple[dict[str, float], float], held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        kept: dict[str, tuple[str, ...]] = {}  # the telling features of the words seen

        def telling(text: str | None) -> set[str]:
            found: set[str] = set()
            words = set(WORDS((text or "").lower()))
            if len(kept) > CACHE_WORDS:
                kept.clear()
            for w in words:
                hits = kept.get(w)
                if hits is None:
                    hits = tuple(x for x in parts_of(w) if x in weights)
                    if len(w) <= LONG_WORD:
                        kept[w] = hits
                if hits:
                    found.update(hits)
            return found

        for batch in batches:
            z = np.array([bias + sum(weights[x] for x in sorted(telling(t))) for t in batch.column(2).to_pylist()], float)
            got = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", held_out) == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
