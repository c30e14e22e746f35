"""Every stage of the pipeline against a brute-force version on what the stage before kept."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import entry, mixing, order_minhash, packing, quality

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seen(spark):
    """The documents and what each stage made of them."""
    frames = [spark.read.parquet(f"{SMALL}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SMALL).cache())
    return frames


def texts(df) -> dict:
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(seen):
    assert all(s.columns == seen[0].columns for s in seen[:-1]) and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "mixing", "packing"]


def test_quality_stage(spark, seen):
    """The rows whose plain mean of weights, plus the bias, reaches the threshold."""
    model = quality.train(seen[0], spark.read.parquet(f"{SMALL}/labels.parquet"), held_out=None)

    def plain(text: str | None) -> float:
        at, n = quality.features(text)
        return 1 / (1 + np.exp(-(float(model.weights[at].astype(float) @ n) + model.bias))) if len(at) else model.empty

    scores = {k: plain(t) for k, t in texts(seen[0]).items()}
    assert all(abs(s - 0.3) > 1e-6 for s in scores.values())
    assert texts(seen[1]) == {k: t for k, t in texts(seen[0]).items() if scores[k] >= 0.3} and len(texts(seen[1])) < len(scores)


def test_line_stage(seen):
    before, held = texts(seen[1]), defaultdict(set)
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(" \t\n\x0b\x0c\r"))
    for k, t in before.items():
        for line in (t or "").split("\n"):
            held[key(line)].add(k)
    gone = {line: max(ids) for line, ids in held.items() if len(line) >= 20 and len(ids) >= 3}
    want = {k: None if t is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), k) == k) for k, t in before.items()}
    assert texts(seen[2]) == want and all(r.n_chars == len(r.text) for r in seen[2].collect() if r.text is not None)


def test_near_stage(seen):
    """Of all pairs that align, one row of each component stays: that with the smallest id."""
    rows, shingler = sorted(texts(seen[2]).items()), order_minhash.Shingler()
    plain = [shingler.shingles(shingler.words(t)) for _, t in rows]
    both = [(x, order_minhash.label(x)) for x in plain]
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if len(plain[i]) and len(plain[j]) and order_minhash.alike(both[i], both[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert texts(seen[3]) == {doc: t for k, (doc, t) in enumerate(rows) if find(k) == k}


def test_mixing_stage(seen):
    """Copies are whole texts, two at most; each source's words come near the target by water-filling."""
    before, taken = texts(seen[3]), Counter(r.doc_id for r in seen[4].collect())
    assert all(r.text == before[r.doc_id] for r in seen[4].collect()) and max(taken.values()) <= 2
    plain = {k: sum(1 for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w) for k, t in before.items()}
    source = {r.doc_id: r.source for r in seen[3].collect()}
    sizes, got, largest = Counter(), Counter(), Counter()
    for k, n in plain.items():
        sizes[source[k]] += n
        got[source[k]] += n * taken[k]
        largest[source[k]] = max(largest[source[k]], n)
    goal = mixing.targets(dict(sizes))
    assert all(abs(got[s] - goal[s]) <= max(0.02 * goal[s], largest[s]) for s in goal)


def test_packing_stage(seen):
    """All rows of the mix are there, piece by piece, with the ids that the tokenizer gives, gapless in their sequences."""
    tokenizer = packing.WordTokenizer(entry.tokenizer_path())
    want, rows = Counter(), seen[5].collect()
    for r in seen[4].collect():
        ids = tokenizer._encode(r.text or "") + b"\0\0\0\0"
        for k, (start, length) in enumerate(packing.cut(len(ids) // 4)):
            want[r.doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    alone = packing.sequences(packing.best_fit(Counter(r.length for r in rows)))
    assert len(held) <= alone


def test_run(spark, seen):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset").collect()) == sorted(tuple(r) for r in seen[5].drop("sequence_id", "offset").collect())


NAMES = ["_doc", "_hash", "_keep", "_rank", "_alone", "_bitmap", "_key", "_id", "_copies", "_n", "_copy", "uid", "score", "id", "y", "a.b", "c0", "key"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("*", *[F.concat(F.lit("mine "), F.col("doc_id")).alias(n) for n in NAMES])
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, "word", None, "s", 4), (-2, "word", None, "s", 4)], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    docs = docs.unionByName(odd.select("*", *[F.concat(F.lit("mine "), F.col("doc_id")).alias(n) for n in NAMES]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == (None if r.doc_id is None else f"mine {r.doc_id}") for r in rows for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SMALL).count() == 0, name
