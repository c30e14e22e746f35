"""Near-duplicates against all pairs, on a small made corpus and on the documents."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import order_minhash as om

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[str | None]:
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(120)
    out: list[str | None] = [None, "", "  \n ", "one", "one", "One!", "one two", "one two three four five", "one two three four five six"]
    for n in (6, 9, 15, 40, 150, 400):  # copies with words changed, more and more
        base = text(n).split()
        out.append(" ".join(base))
        for changes in range(5):
            copy = [*base]
            for _ in range(changes):
                copy[rng.randrange(n)] = rng.choice(words)
            out.append(" ".join(copy))
        out.append(" ".join(base[n // 2 :] + base[: n // 2]))
    base = text(100).split()
    for _ in range(60):  # a large group whose members differ from each other about as much as the threshold allows
        copy = [*base]
        for _ in range(2):
            copy[rng.randrange(100)] = rng.choice(words)
        out.append(" ".join(copy))
    for _ in range(60):  # a passage that most of the text is, in documents that are no copies
        out.append(f"{passage} {text(rng.randrange(20, 60))}")
    return out


def expected(texts: list[str | None]) -> list[int]:
    shingler = om.Shingler()
    x = [shingler.labelled(shingler.words(t)) for t in texts]
    root = list(range(len(x)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(x)):
        for j in range(i):
            if len(x[i]) and len(x[j]) and om.aligned(x[i], x[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(x))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(corpus())], SCHEMA)


def test_equals_all_pairs(docs):
    want = expected(corpus())
    got = {r.doc_id: (r.class_id, r.kept) for r in om.near_duplicates(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(want))
    assert all(kept == (k == c) for k, (c, kept) in got.items())


def test_one_of_each(docs):
    want = expected(corpus())
    kept = sorted(r.doc_id for r in om.one_of_each(docs).collect())
    assert kept == [k for k, c in enumerate(want) if k == c]


def test_small_blocks(docs, monkeypatch):
    """Buckets over many blocks, and blocks of single documents."""
    monkeypatch.setattr(om, "BLOCK", 7)
    monkeypatch.setattr(om, "BLOCK_SHINGLES", 300)
    assert {r.doc_id: r.class_id for r in om.near_duplicates(docs).collect()} == dict(enumerate(expected(corpus())))


def test_alignment_needs_order():
    shingler = om.Shingler()
    a = shingler.labelled(shingler.words(" ".join(f"a{k}" for k in range(100))))
    assert om.aligned(a, a) and not om.aligned(a, a[::-1].copy()) and not om.aligned(a, np.concatenate([a[:60], a[:40] + np.uint64(1)]))


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g", "en", "s", 1), (5, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", None, None, None), (7, None, None, None, None), (3, "A b, c d e f g", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.class_id or 0) for r in om.near_duplicates(df).collect()) == [(False, 0, 0), (True, 3, 3), (True, 5, 3), (True, 5, 3), (True, 7, 7)]
    assert sorted(r.doc_id or 0 for r in om.one_of_each(df).collect()) == [0, 3, 7]
    assert om.near_duplicates(df.filter("false")).count() == 0 and om.one_of_each(df.filter("false")).columns == df.columns


def test_documents(spark):
    """Every pair of the documents that aligns is in one class, near copies included, and no class holds more than such chains."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in om.near_duplicates(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    shingler = om.Shingler()
    plain = [shingler.shingles(shingler.words(t)) for _, t in rows]
    texts = [(x, om.label(x)) for x in plain]
    held, root, links = defaultdict(list), list(range(len(rows))), 0

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, x) in enumerate(texts):
        common = Counter(j for v in x.tolist() for j in held[v])
        for v in x.tolist():
            held[v].append(i)
        for j, n in common.items():
            if n / (len(x) + len(texts[j][1]) - n) >= om.THRESHOLD - 1e-9 and om.alike(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b], links = a, links + 1
    assert links >= 50 and got == {doc: rows[find(k)][0] for k, (doc, _) in enumerate(rows)}


def test_shared_ids_and_clashing_names(spark):
    """Id 5 has two texts, of which 7 copies the one nearly and 8 the other; 2 copies one exactly: all are one class."""
    base = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    rows = [(5, base("a", 100)), (5, base("b", 100)), (7, base("a", 100) + " more"), (8, base("b", 100) + " more"), (9, base("c", 50)), (9, base("c", 50)), (4, "½ ²"), (4, "½ ²"), (6, "--"), (6, "--")]
    names = {"_doc": "mine", "_hash": "mine", "_keep": "mine", "_rank": "mine", "_alone": "mine", "c1": "mine", "uid": "mine", "a.b": "mine"}
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    docs = plain.select("*", *[F.lit(v).alias(k) for k, v in names.items()])
    assert sorted((r.doc_id, r.class_id) for r in om.near_duplicates(docs).collect()) == [(4, 4), (4, 4), (5, 5), (5, 5), (6, 6), (6, 6), (7, 5), (8, 5), (9, 9), (9, 9)]
    kept = om.one_of_each(docs)
    assert kept.columns == docs.columns and all(r[k] == v for r in kept.collect() for k, v in names.items())
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 6, 9]  # equal texts with a word are one, texts without stay
    more = plain.unionByName(spark.createDataFrame([(2, base("b", 100))], plain.schema))
    assert {r.class_id for r in om.near_duplicates(more).collect() if r.doc_id in (2, 5, 7, 8)} == {2}


def test_bitmaps_lose_nothing():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = om.mix64(rng.integers(0, 1 << 40, n).astype(np.uint64))
        y = np.concatenate([x[rng.random(n) < 0.9], om.mix64(rng.integers(0, 1 << 40, int(rng.integers(0, 1 + n // 10))).astype(np.uint64))])
        common = len(np.intersect1d(x, y))
        if len(y) and common >= om.needed(n, len(y)):
            assert om.linkable(n, np.frombuffer(om.bitmap(x), np.uint64), len(y), np.frombuffer(om.bitmap(y), np.uint64))


def test_long_text(spark):
    text = " ".join(f"w{k % 5003}x{k % 7}" for k in range(120_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("w17x", "other", 1)), (3, text[: len(text) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in om.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def longest(x: list, y: list) -> int:
    """The longest common subsequence by the plain dynamic program."""
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def repeated_lines() -> list[tuple[str, str]]:
    """Texts that repeat a line, and copies with words changed, added or lost."""
    rng = random.Random(9)
    out = []
    for words, times in ((20, 30), (12, 40), (30, 20), (3, 60), (7, 25)):
        base = [f"r{words}x{k}" for k in range(words)] * times
        for changes in (1, 2, 4, 8, 16, 24):
            copy = [*base]
            for c in range(changes):
                at = 5 if c == 0 else rng.randrange(len(copy))
                copy[at : at + rng.choice((0, 1, 1))] = rng.choice(([], [f"c{changes}w{c}"], [f"c{changes}w{c}", "again"]))
            out.append((" ".join(base), " ".join(copy)))
        out.append((" ".join(base), " ".join(base[: len(base) * 4 // 5])))
    return out


def test_repeated_shingles_equal_plain_alignment(monkeypatch):
    shingler = om.Shingler()
    seen = {True: 0, False: 0}
    for rows in (om.ROWS, 7):
        monkeypatch.setattr(om, "ROWS", rows)
        for a, b in repeated_lines():
            x, y = (shingler.shingles(shingler.words(t)) for t in (a, b))
            best = longest(x.tolist(), y.tolist())
            assert om.chained(x, y, best) and not om.chained(x, y, best + 1)
            want = best / (len(x) + len(y) - best) >= om.THRESHOLD
            assert om.alike((x, om.label(x)), (y, om.label(y))) == want
            seen[want] += 1
    assert all(seen.values())
    rng = np.random.default_rng(3)
    for _ in range(300):  # few different entries, lengths about a window
        x, y = (rng.integers(0, rng.integers(1, 6), rng.integers(0, 40)).astype(np.uint64) for _ in "ab")
        best = longest(x.tolist(), y.tolist())
        assert om.chained(x, y, best) and not om.chained(x, y, best + 1)


def test_copies_of_repeated_lines(spark, monkeypatch):
    """A word changed near the start, found by the first comparison and by that of blocks."""
    texts = []
    for words, times in ((20, 30), (12, 40), (30, 20)):
        base = [f"r{words}x{k}" for k in range(words)] * times
        texts += [" ".join(base), " ".join([*base[:7], "other", *base[8:]])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.class_id for r in om.near_duplicates(docs).collect()} == {k: k // 2 * 2 for k in range(6)}
    shingler = om.Shingler()
    rows = [{"uid": k, "component": k, "x": shingler.shingles(shingler.words(t)).tobytes()} for k, t in enumerate(texts)]
    block = om.pa.array([rows], om.pa.list_(om.pa.struct([("uid", om.pa.int64()), ("component", om.pa.int64()), ("x", om.pa.binary())])))
    batch = om.pa.RecordBatch.from_arrays([om.pa.array([True]), om.pa.array([0]), block, block], ["same", "key", "block_a", "block_b"])
    assert [(r["a"], r["b"]) for out in om._block_links([batch]) for r in out.to_pylist()] == [(0, 1), (2, 3), (4, 5)]
