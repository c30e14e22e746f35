"""Held-out accuracy of the learned operators, their arithmetic against plain loops, and their odd rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import entry, langid, quality, toxicity
from quadrille.llm.common import chosen_by, fold, sample_threshold

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, " \n\t ", "en", "s", 4), (-4, "1234 !!", "en", "s", 7), (None, "words without an id", None, "s", 1), (-5, "word " * 50_000, None, "s", 250_000)]


def with_odd(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    return docs.unionByName(spark.createDataFrame(ODD, docs.schema)).withColumn("score", F.lit("clash")), spark.read.parquet(f"{path}/labels.parquet")


def test_language(spark):
    docs, _ = with_odd(spark, MEDIUM)
    rows = langid.identify(docs, langid.train(docs)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) == docs.count() and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (-1, -2, -3, -4)} == dict.fromkeys((-1, -2, -3, -4), "und")
    assert all(0 <= r.score <= 1 for r in rows)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none, langid.train(none)).collect()} == {"und"}


def plain_em(n: np.ndarray, p: np.ndarray, langs: list[int], rounds: int = 3000) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of one document, word by word."""
    pi = {k: 1 / len(langs) for k in langs}
    for _ in range(rounds):
        gained = dict.fromkeys(langs, 0.0)
        for count, row in zip(n, p, strict=True):
            total = sum(pi[k] * row[k] for k in langs)
            for k in langs:
                gained[k] += count * pi[k] * row[k] / total
        new = {k: v / n.sum() for k, v in gained.items()}
        moved, pi = max(abs(new[k] - pi[k]) for k in langs), new
        if moved < 1e-9:
            break
    return np.array([pi.get(k, 0.0) for k in range(p.shape[1])]), sum(c * np.log(sum(pi[k] * row[k] for k in langs)) for c, row in zip(n, p, strict=True))


def test_mixture_equals_a_plain_loop():
    """Several documents at once against expectation-maximisation word by word, and the language set against all prefixes."""
    rng = np.random.default_rng(1)
    sizes, langs = [5, 40, 90, 25, 60], 6
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = rng.integers(1, 4, len(doc)).astype(float)
    p = rng.random((len(doc), langs)) ** 6
    for d in range(len(sizes)):  # words of the document's own d + 1 languages
        for k in np.flatnonzero(doc == d):
            p[k, rng.integers(0, d + 1)] = 1
    p = np.maximum(p / p.max(1, keepdims=True), langid.FLOOR)
    pi, ll = langid.mixture(doc, n, p, np.ones((len(sizes), langs)))
    chosen = langid.infer(doc, n, p, len(sizes))
    for d in range(len(sizes)):
        own = doc == d
        want, reach = plain_em(n[own], p[own], [*range(langs)])
        slack = langid.GAP + langid.GAP_WORD * n[own].sum() + 1e-6
        assert reach - slack <= ll[d] <= reach + 1e-6 and pi[d].sum() == pytest.approx(1)
        alone = [(n[own] * np.log(p[own, k])).sum() for k in range(langs)]
        values = {1: max(alone)}
        order = np.argsort(-want, kind="stable")
        for k in range(2, langs + 1):
            values[k] = plain_em(n[own], p[own], order[:k].tolist())[1] - langid.PENALTY * (k - 1) * np.log(n[own].sum() + 1)
        best = max(values.values())
        assert values[int((chosen[d] > 0).sum())] >= best - 2 * slack


def test_five_languages():
    """All of a document's languages are found, however many."""
    rng = np.random.default_rng(2)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"[5 * k : 5 * k + 6]), 5)) for _ in range(60)] for k in range(5)}
    model = langid.fit([(lang, " ".join(ws)) for lang, ws in words.items()])
    shares = [0.35, 0.25, 0.2, 0.12, 0.08]
    text = [w for ws, share in zip(words.values(), shares, strict=True) for w in (ws * 20)[: int(600 * share)]]
    doc, n, p = model.lookup([Counter(text), Counter(words["l1"] * 5)])
    got = langid.infer(doc, n, p, 2)
    assert got[0] == pytest.approx(shares, abs=0.04) and (got[1] > 0).tolist() == [False, True, False, False, False]


def test_letters(spark):
    assert langid.words_of("½ ² Ⅷ x٣y") == ["x", "y"] and langid.words_of("Ünï-cödé ªº №5 слово") == ["ünï", "cödé", "ªº", "слово"]
    model = langid.fit([("aa", "some words"), ("bb", "other things")])
    docs = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "１２ ৪"), (3, "some")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()} == {1: "und", 2: "und", 3: "aa"}


def test_long_texts_are_learned(spark):
    """A language, a label and a kind of toxic text that only very long texts hold."""
    long = lambda w: " ".join(f"{w}{k % 50}" for k in range(6000))
    rows = [(k, long("zq" if k % 2 else "ab"), "zz" if k % 2 else "aa") for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    assert all(r.lang_pred == ("zz" if r.doc_id % 2 else "aa") for r in langid.identify(docs, langid.train(docs)).collect())
    assert all(r.predicted == r.doc_id % 2 for r in quality.score(docs, quality.train(docs, labels)).collect())
    rare = spark.createDataFrame([(k, long("zq" if k % 10 == 0 else "ab") if k % 5 == 0 else "ab1 ab2 ab3") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(400)], "doc_id long, toxic int")
    assert all(r.predicted == int(r.doc_id % 10 == 0) for r in toxicity.score(rare, toxicity.train(rare, labels)).collect())


def test_sample_threshold(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4990, "a").otherwise("b"))
    limits = sample_threshold(df, F.col("g"), 100)
    assert set(limits) == {"a", "b"} and sample_threshold(df.filter("false"), F.col("g"), 9) == {}
    taken = Counter(r.g for r in df.filter(chosen_by(limits, F.col("g"), F.col("id"))).collect())
    assert taken["b"] == 10 and 60 <= taken["a"] <= 140 and not df.filter(chosen_by({}, F.col("g"), F.col("id"))).count()
    with pytest.raises(ValueError, match="labels"):
        sample_threshold(df, F.col("id"), 1)


TEXTS = [None, "", " \n\t", "one", "one two one two one", "a a a a b b", "Straße ÉÉ x²", "word " * 5000, " ".join(f"w{k}" for k in range(3000)), "x" * 5000]


def test_quality_score_equals_a_plain_sum():
    rng = np.random.default_rng(4)
    weights, bias, empty = rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3, 0.77
    model = quality.Model(weights, bias, empty)
    for got, text in zip(model.score(TEXTS) + model.score(TEXTS[::-1])[::-1], TEXTS * 2, strict=True):
        words = (text or "").split()
        parts = []
        for k, w in enumerate(words):
            owner, bucket = quality.ngram_hashes([w], quality.NGRAMS, quality.BUCKETS)
            parts += [*weights[bucket], weights[quality.hash_word(w) % quality.BUCKETS]]
            parts += [weights[quality.BACK[j - 1]] for j in (1, 2, 3) if k >= j and words[k - j] == w]
            if k:
                pair = np.array([quality.hash_word(words[k - 1]), quality.hash_word(w)], np.uint64)
                parts.append(weights[quality.pair_buckets(pair)[0]])
        assert got == pytest.approx(1 / (1 + np.exp(-(np.mean(parts, dtype=float) + bias))) if words else empty, rel=1e-5)
        at, n = quality.features(text)
        if words:
            assert n.sum() == pytest.approx(1, rel=1e-4) and weights[at] @ n == pytest.approx(np.mean(parts, dtype=float), abs=1e-4)


def test_word_order_counts():
    """Texts of the same words in two orders get different features."""
    a, b = (quality.features(t) for t in ("red green blue black", "blue red black green"))
    assert not (len(a[0]) == len(b[0]) and (a[0] == b[0]).all())


def test_toxicity_score_equals_a_plain_sum(spark):
    model = ({"bad": 2.0, "badl-": 0.5, "-word": 1.5, "w17": -0.25}, -1.0)
    docs = spark.createDataFrame([*enumerate([*TEXTS, "a bad badly Word swordword"])], "doc_id long, text string")
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        z = model[1] + sum(v for x, v in model[0].items() if x in {p for w in "".join(c if c.isalnum() else " " for c in (r.text or "").lower()).split() for p in [w, *[w[:k] + "-" for k in (4, 5, 6) if len(w) > k], *["-" + w[-k:] for k in (4, 5, 6) if len(w) > k]]})
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_risk_is_corrected_and_non_negative():
    """Unlabelled text with as many positives as the prior says: the classifier tells them from the rest."""
    rng = np.random.default_rng(6)
    vocabulary = toxicity.Vocabulary()
    text = lambda bad: vocabulary.encode([*(f"n{k}" for k in rng.integers(0, 200, 30)), *((f"t{k}" for k in rng.integers(0, 12, 3)) if bad else ())])
    positive, hidden, clean = ([text(bad) for _ in range(size)] for bad, size in ((True, 150), (True, 120), (False, 480)))
    names = vocabulary.names()
    weights, bias = toxicity.fit(positive, hidden + clean, names, 0.2, 4.5)
    found, wrong = (np.mean([bias + sum(weights.get(names[k], 0) for k in x) >= np.log(0.3 / 0.7) for x in rows]) for rows in (hidden, clean))
    assert found >= 0.9 and wrong <= 0.1


@pytest.mark.parametrize(("module", "column", "modulus", "part", "least"), [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 4, 2, 0.8)])
def test_scores(spark, module, column, modulus, part, least):
    docs, labels = with_odd(spark, MEDIUM)
    model = module.train(docs, labels)
    scored = module.score(docs, model).cache()
    assert scored.count() == docs.count() and scored.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int) or score is null").count() == 0
    wrong = scored.join(labels, "doc_id").filter(F.col("held_out") != (fold("doc_id", modulus) == part)).count()
    held = [(r.score, r[column]) for r in scored.filter("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert wrong == 0 and auc >= least
    nothing = module.score(docs, module.train(docs, labels.filter("false")))
    assert nothing.count() == docs.count() and nothing.select("score").distinct().count() == 1


def test_labels_are_no_input(spark):
    """Labels of held-out rows change nothing."""
    docs, labels = with_odd(spark, SMALL)
    turn = lambda c, modulus, part: labels.withColumn(c, F.when(fold("doc_id", modulus) == part, 1 - F.col(c)).otherwise(F.col(c)))
    one, two = (quality.train(docs, x) for x in (labels, turn("quality", 5, 0)))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    assert toxicity.train(docs, labels) == toxicity.train(docs, turn("toxic", 4, 2))
    turned = docs.withColumn("lang", F.when(fold("doc_id", 3) == 1, "xx").otherwise(F.col("lang")))
    one, two = langid.train(docs), langid.train(turned)
    assert one.langs == two.langs and np.array_equal(one.logp, two.logp)


def test_keep_good(spark):
    docs, labels = with_odd(spark, SMALL)
    model = quality.train(docs, labels, held_out=None)
    kept = quality.keep_good(docs, model)
    want = {r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in entry.QUERIES} and set(entry.SQL) <= set(entry.QUERIES)
