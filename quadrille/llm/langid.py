"""Language identification by multilingual mixture inference.

Each language has a model of hashed character n-grams of words, ends marked.  A document is a mixture: every
word comes from one of its languages, with the language's proportion as prior.  Expectation-maximisation estimates
the proportions from the words' likelihoods, until what the log-likelihood can still gain, which the words' responsibilities bound, is
GAP or less.  The language set is the prefix of the languages, by proportion, with
the best penalised likelihood: log-likelihood less PENALTY * log(words) for each further language.  Prefixes grow until not even the
likelihood of all languages could pay for one more; no number of languages and no share is cut off.

The n-gram models are fitted on FIT_ROWS rows or fewer of each language, chosen by the hash of the
id among the rows with a language outside the held-out fold; they are counted where they are read.  Texts of more than FIT_WORDS words count
as so many.  Scoring reads whole texts only.

Defined results: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; so is every text if no row
has a language.  Repeated rows get the same result; further columns are ignored.  More than MOST_LABELS languages are an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen_by, fold, ngram_hashes, sample_threshold

BUCKETS, NGRAMS, SMOOTH = 1 << 15, (1, 2, 3), 0.5
FIT_ROWS, FIT_WORDS = 400, 2000
PENALTY = 4.0
#: What the log-likelihood may still gain when expectation-maximisation ends: so much, and so much a word.
GAP, GAP_WORD = 0.05, 1e-4
#: A word is never held to be less likely than so, against the language that fits it best: names and typing errors.
FLOOR = 1e-3
HELD_OUT = 3
CACHE_WORDS, LONG_WORD = 200_000, 40
LETTERS, PLAIN_LETTERS = regex.compile(r"\p{L}+").findall, re.compile(r"[^\W\d_]+").findall
#: Characters for which the two could differ: numbers that are no digits, and what lies beyond the Latin blocks.
NOT_PLAIN = re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]").search
OUT = "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; long ones, as of scripts without spaces, in parts."""
    text = (text or "").lower()
    words = LETTERS(text) if NOT_PLAIN(text) else PLAIN_LETTERS(text)
    if words and len(max(words, key=len)) > LONG_WORD:
        words = [w[k : k + LONG_WORD] for w in words for k in range(0, len(w), LONG_WORD)]
    return words


class Model:
    """Log-probabilities of n-gram buckets by language; a worker keeps the likelihoods of the words it has seen."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.empty((CACHE_WORDS, len(self.langs)), np.float32)

    def state(self) -> tuple[list[str], np.ndarray]:
        return self.langs, self.logp

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Of each word under each language, relative to the best, FLOOR at least."""
        owner, bucket = ngram_hashes(words, NGRAMS, BUCKETS)
        # each position counts once: the mean over the n-gram sizes
        ll = np.stack([np.bincount(owner, row[bucket], len(words)) for row in self.logp], 1) / len(NGRAMS)
        return np.maximum(np.exp(ll - ll.max(1, keepdims=True)), FLOOR)

    def lookup(self, counted: list[Counter]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, count, likelihood row) of the different words of each document."""
        new = {w for c in counted for w in c if w not in self.at}
        if len(self.at) + len(new) > CACHE_WORDS:
            self.at.clear()
            new = {w for c in counted for w in c}
            if len(new) > CACHE_WORDS:
                self.rows = np.empty((len(new), len(self.langs)), np.float32)
        fresh = [*new]
        for k in range(0, len(fresh), 1 << 14):
            part, base = fresh[k : k + (1 << 14)], len(self.at)
            self.rows[base : base + len(part)] = self.likelihoods(part)
            self.at.update(zip(part, range(base, base + len(part)), strict=True))
        sizes = [len(c) for c in counted]
        at = np.fromiter((self.at[w] for c in counted for w in c), np.int64, sum(sizes))
        n = np.fromiter((k for c in counted for k in c.values()), np.float64, sum(sizes))
        return np.repeat(np.arange(len(counted)), sizes), n, self.rows[at].astype(np.float64)


def starts_of(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])


def mixture(doc: np.ndarray, n: np.ndarray, p: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: (proportions, log-likelihood).  ``doc`` is sorted and counts from 0; every document has a word.

    The log-likelihood is concave: with g the mean responsibility of a language over its proportion, it can gain words * (max g - 1) at
    most.  Documents leave as they come near enough.
    """
    docs = len(allowed)
    pi_out, ll_out = np.zeros(allowed.shape), np.zeros(docs)
    left, pi = np.arange(docs), allowed / allowed.sum(1, keepdims=True)
    while len(left):
        starts = starts_of(doc)
        total = np.add.reduceat(n, starts)
        mix = (p * pi[doc]).sum(1)
        g = np.add.reduceat(p * (n / mix)[:, None], starts, axis=0) / total[:, None]
        near = total * (np.where(allowed > 0, g, 0).max(1) - 1) <= GAP + GAP_WORD * total
        if near.any():
            ll = np.add.reduceat(n * np.log(mix), starts)
            pi_out[left[near]], ll_out[left[near]] = pi[near], ll[near]
            rows = ~near[doc]
            doc, n, p = (np.cumsum(~near) - 1)[doc[rows]], n[rows], p[rows]
            left, pi, g, allowed = left[~near], pi[~near], g[~near], allowed[~near]
        pi = pi * g
        pi /= pi.sum(1, keepdims=True)
    return pi_out, ll_out


def infer(doc: np.ndarray, n: np.ndarray, p: np.ndarray, docs: int) -> np.ndarray:
    """Proportions of each document over its selected languages."""
    langs = p.shape[1]
    if langs == 1:
        return np.ones((docs, 1))
    starts = starts_of(doc)
    price = PENALTY * np.log(np.add.reduceat(n, starts) + 1)
    alone = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
    best = np.zeros((docs, langs))
    best[np.arange(docs), alone.argmax(1)] = 1
    reached = alone.max(1)
    # a mixture never fits a word better than the language that fits it best: most documents end here
    open_ = np.add.reduceat(n * np.log(p.max(1)), starts) - price > reached
    if not open_.any():
        return best
    kept, rows = np.flatnonzero(open_), open_[doc]
    doc, n, p = (np.cumsum(open_) - 1)[doc[rows]], n[rows], p[rows]
    full, most = mixture(doc, n, p, np.ones((len(kept), langs)))
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, langs + 1):
        stay = most + GAP + GAP_WORD * np.exp(price[kept] / PENALTY) - price[kept] * (k - 1) > reached[kept]
        if not stay.any():
            break
        rows = stay[doc]
        doc, n, p = (np.cumsum(stay) - 1)[doc[rows]], n[rows], p[rows]
        kept, most, order = kept[stay], most[stay], order[stay]
        allowed = np.zeros((len(kept), langs))
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        pi, ll = mixture(doc, n, p, allowed)
        value = ll - price[kept] * (k - 1)
        better = value > reached[kept]
        best[kept[better]] = pi[better]
        reached[kept[better]] = value[better]
    return best


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's n-grams, of FIT_WORDS words at most in weight."""
    seen = Counter(words_of(text))
    if not seen:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    owner, bucket = ngram_hashes([*seen], NGRAMS, BUCKETS)
    found = np.bincount(bucket, np.fromiter(seen.values(), float)[owner], BUCKETS) * min(1.0, FIT_WORDS / seen.total())
    at = np.flatnonzero(found)
    return at.astype(np.int32), found[at].astype(np.float32)


def model_of(counts: dict[str, np.ndarray]) -> Model:
    langs = sorted(counts)
    logp = np.empty((len(langs), BUCKETS), np.float32)
    for k, lang in enumerate(langs):
        logp[k] = np.log((counts[lang] + SMOOTH) / (counts[lang].sum() + SMOOTH * BUCKETS))
    return Model(langs, logp)


def fit(texts: list[tuple[str, str]]) -> Model:
    """From (language, text) pairs."""
    sums: dict[str, np.ndarray] = {}
    for lang, text in texts:
        at, n = counts_of(text)
        np.add.at(sums.setdefault(lang, np.zeros(BUCKETS)), at, n)
    return model_of(sums)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts_of(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], ["lang", "doc_id", "at", "n"])


def _summed(table: pa.Table) -> pa.Table:
    """A language's counts: 2 * FIT_ROWS sparse rows at most, added in the order of ids."""
    total = np.zeros(BUCKETS)
    for row in sorted(table.select(["doc_id", "at", "n"]).to_pylist(), key=lambda r: (r["doc_id"], r["at"], r["n"])):
        total[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["n"], np.float32)
    return pa.table({"lang": table["lang"].slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, held_out: int | None = HELD_OUT, fit_rows: int = FIT_ROWS) -> Model:
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text").filter("lang is not null and doc_id is not null and text <> ''")
    if held_out:
        known = known.filter(fold("doc_id", held_out) != 1)
    limits = sample_threshold(known, F.col("lang"), fit_rows)
    counted = known.filter(chosen_by(limits, F.col("lang"), F.col("doc_id"))).mapInArrow(_counted, "lang string, doc_id long, at binary, n binary")
    sums = counted.groupBy("lang").applyInArrow(_summed, "lang string, total binary")  # BUCKETS floats a language
    return model_of({r.lang: np.frombuffer(r.total) for r in sums.collect()})


def identify(docs: DataFrame, model: Model, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages): the language with the largest share, its share, and all of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # BUCKETS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        langs = model.langs
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counted = [Counter(words_of(t)) for t in batch.column(2).to_pylist()]
                some = np.array([bool(c) and bool(langs) for c in counted], bool)
                pred, score, sets = ["und"] * len(counted), np.zeros(len(counted)), [[] for _ in counted]
                if some.any():
                    doc, n, p = model.lookup([c for c, s in zip(counted, some, strict=True) if s])
                    pi = infer(doc, n, p, int(some.sum()))
                    for k, row in zip(np.flatnonzero(some), pi, strict=True):
                        top = int(row.argmax())
                        pred[k], score[k] = langs[top], min(1.0, row[top])
                        sets[k] = [{"lang": langs[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score), pa.array(sets, kind)], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", held_out) == 1).alias("held_out"), "text").mapInArrow(run, OUT)
