"""Counts, base and model scores against plain dictionaries."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from wiretally.llm import interpolation as lm
from wiretally.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"


def tokens_of(text: str | None) -> list:
    return [*(text or "").encode().lower().split(), None]


def plain(docs: dict[int, str], role: dict[int, int], weights) -> dict[int, tuple]:
    words, pairs = Counter(), Counter()
    train = [i for i in docs if role[i] != lm.SCORED]
    for i in train:
        own = tokens_of(docs[i])
        words.update(own)
        pairs.update(zip([0, *own[:-1]], own, strict=True))
    n, v = sum(words.values()), len(words)
    found = {}
    for i, text in docs.items():
        own = tokens_of(text)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        score = 0.0
        for c, w in zip([0, *own[:-1]], own, strict=True):
            seen = len(train) if c == 0 else words[c]
            a = weights[min(math.ceil(math.log2(seen + 1)), 47)]
            score += math.log10(a[0] * pairs[c, w] / max(seen, 1) + a[1] * words[w] / max(n, 1) + a[2] / (v + 1))
        found[i] = (len(own), sum(words[w] > 0 for w in own), n, base, score)
    return found


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 20_000])
def test_query_equals_plain_counts(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk_bytes)
    seen = {}
    learn = lm.learned_weights

    def watched(*args):
        seen["weights"] = learn(*args)
        return seen["weights"]

    monkeypatch.setattr(lm, "learned_weights", watched)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in docs}
    role = {i: {1: lm.SCORED, 2: lm.HELD}.get(k, lm.COUNTED) for i, k in fold.items()}
    rows = queries()["op8_lm_scoring"](spark, SF_DIR).collect()
    truth = plain(docs, role, seen["weights"])
    assert len(rows) == len(docs)
    for r in rows:
        n_tokens, n_known, n, base, score = truth[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        assert r.held_out == (fold[r.doc_id] == 1)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_sum_to_one_and_follow_the_evidence():
    cell = np.array([(3 << 32) | (1 << 16) | 20, (3 << 32) | 20, (5 << 32) | (1 << 16) | 40])
    weights = lm.learned_weights(cell, np.array([10, 10, 50]), 1000)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all()
    assert weights[0, 0] == 0 and weights[5, 0] > weights[3, 0] > 0.2
    assert (weights[6] == weights[5]).all()


def test_edge_rows(spark):
    rows = [
        (1, "a b A", 1), (1, "a b A", 1), (2, None, 1), (3, "", 0), (None, "c", 0), (4, "word " * 60_000, 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, role int").withColumn("n", F.lit(1))
    found = lm.scored(docs, F.col("role")).collect()
    assert len(found) == len(rows)
    assert all(r.train_tokens == 4 + 4 + 1 + 60_001 and math.isfinite(r.score) for r in found)
    assert sorted((r.id or 0, r.n_tokens, r.n_known) for r in found) == [
        (0, 2, 1), (1, 4, 4), (1, 4, 4), (2, 1, 1), (3, 1, 1), (4, 60_001, 60_001),
    ]
    none = lm.scored(docs, F.lit(0)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in none)
    assert lm.scored(docs.limit(0), F.lit(1)).count() == 0


def test_a_task_holds_few_arrays_of_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 1 << 12, raising=False)
    picked = np.random.default_rng(1).zipf(1.3, 600_000) % 200_000
    rows = [(k, " ".join(f"w{i}" for i in part), k % 3) for k, part in enumerate(np.split(picked, 600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, role int").coalesce(1)
    chunk = lm.encoded(docs, F.col("role"), "doc_id", "text").toArrow().combine_chunks()
    n = chunk.column("n_tokens")[0].as_py()
    assert chunk.num_rows == 1 and n == 600_600
    peaks = {}

    def peak(step, made):
        tracemalloc.start()
        try:
            return made()
        finally:
            peaks[step] = tracemalloc.get_traced_memory()[1] / n
            tracemalloc.stop()

    parts = 2
    batches = chunk.select(lm._CHUNK_COLUMNS).to_batches()
    asked = peak("requests", lambda: pa.Table.from_batches(list(lm._requests(parts)(iter(batches)))))
    given = [lm._served(parts)(asked.filter(pc.field("part") == p)) for p in range(2 * parts)]
    replies = pa.concat_tables(given)
    replies = replies.filter(pc.field("chunk") != lm._STATS)
    answered = peak("answers", lambda: lm._answered_rows(200_200, 200)(replies, chunk))
    corpus = lm.Corpus((400_400, 200_200), (200_000, 200_000), (400, 200))
    weights = np.full((48, 3), 1 / 3)
    one = answered.to_batches()
    scores = peak("scores", lambda: pa.Table.from_batches(list(lm._scores(corpus, weights)(iter(one)))))
    assert scores.num_rows == 600
    assert max(peaks.values()) < 50, peaks  # bytes a token
