"""Importance resampling against plain counting, and its table against a dict."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wiretally.llm import resampling
from wiretally.llm.resampling import Bytes, importance_draw, intern, ngrams, resampled

SCHEMA = "doc_id long, text string"


def plain_features(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_draw(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    features = [plain_features(t) for _, t in docs]
    s = Counter(bucket(f) for own in features for f in own)
    t = Counter(bucket(f) for _, text in target for f in plain_features(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s
    }
    rows = []
    for (i, _), own in zip(docs, features, strict=True):
        weight = sum(gain[bucket(f)] for f in own) // max(len(own), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(own), weight, score, None])
    fits = [r for r in rows if r[1] >= 2 * least - 1]
    fits.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fits[: len(fits) * percent // 100]):
        r[4] = k + 1
    return rows


def as_rows(found):
    return [tuple(r) for r in found.select("id", "n_features", "weight", "score", "rank").collect()]


def key(r):
    return tuple((x is None, x) for x in r)


def test_hash_is_xxh64():
    data = np.random.default_rng(1).integers(0, 256, 4000, dtype=np.uint8)
    start = np.arange(700) * 3
    length = np.arange(700) % 300
    found = Bytes(data).hashes(start, length)
    expected = [xxhash.xxh64_intdigest(data[i : i + n].tobytes()) for i, n in zip(start, length, strict=True)]
    assert found.tolist() == expected


@pytest.mark.parametrize("same_key", [False, True])
def test_table_keeps_different_bytes_apart(monkeypatch, same_key):
    """Also where all keys collide, so that only the bytes tell n-grams apart."""
    if same_key:
        monkeypatch.setattr(Bytes, "hashes", lambda self, start, length: np.full(len(start), 5, np.uint64))
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in rng.choice([1, 2, 7, 8, 9, 16, 33, 300], 400)]
    length = np.array([len(p) for p in parts])
    start = np.cumsum(length) - length
    found = intern(Bytes(np.frombuffer(b"".join(parts), np.uint8)), start, length, 1000)
    times = Counter(parts)
    slots = {}
    for p, slot in zip(parts, found.slot.tolist(), strict=True):
        assert slots.setdefault(p, slot) == slot
        assert found.bucket[slot] == zlib.crc32(p) % 1000 and found.count[slot] == times[p]
    assert len(set(slots.values())) == len(times) and found.count.sum() == len(parts)


@pytest.mark.parametrize("part", [3, 1 << 17])
def test_ngrams_of_any_text(monkeypatch, part):
    monkeypatch.setattr(resampling, "_PART_WORDS", part)
    texts = ["", "One two, ONE Two  one", "été ÉTÉ x9 - ", "word", "...", "z" * 700 + " b " + "z" * 700, "a b " * 500]
    got = Counter()
    for row, found in ngrams(pa.array(texts), 1000):
        got.update(zip(row.tolist(), found.bucket[found.slot].tolist(), strict=True))
    expected = Counter((i, zlib.crc32(f.encode()) % 1000) for i, t in enumerate(texts) for f in plain_features(t))
    assert got == expected


def test_equals_plain_counting(spark):
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(60)] + ["É", "the"])
    texts = [" ".join(rng.choice(vocabulary, n)) for n in rng.integers(0, 80, 120)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(None, None), (7, ""), (500, texts[1]), (501, "Long " * 30_000), (502, "x" * 100_000)]
    target = [(0, "w1 w2 w3 w1 w2 the the É"), (1, None), (2, "")]
    found = importance_draw(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(target, SCHEMA))
    assert sorted(as_rows(found), key=key) == sorted(map(tuple, plain_draw(docs, target)), key=key)


def test_ties_and_repeated_rows(spark):
    """Equal rows have ranks of their own; equal scores go to the smaller id, null last."""
    text = "some words " * 15
    docs = [(None, text)] * 40 + [(3, text)] * 40 + [(4, text)] * 4
    frame = spark.createDataFrame(docs, SCHEMA).repartition(7)
    found = importance_draw(frame, spark.createDataFrame([], SCHEMA), percent=60)
    assert sorted(as_rows(found), key=key) == sorted(map(tuple, plain_draw(docs, [], percent=60)), key=key)
    assert resampled(frame, frame, percent=60).count() == 84 * 60 // 100


@pytest.mark.parametrize("percent", [0, 100])
def test_none_and_all(spark, percent):
    docs = [(i, "a b c d e f g h i j k l m n o p q r s t u v") for i in range(9)]
    found = as_rows(importance_draw(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(docs, SCHEMA), percent=percent))
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 9 * percent // 100 + 1))


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert importance_draw(empty, empty).count() == 0 and resampled(empty, empty).count() == 0
    schema = "doc_id long, text string, id int, row int, rank int, score string, _key int, _times int, _nth int, `a.b` int"
    docs = spark.createDataFrame([(i, "a b c " * 9, 1, 2, 3, "s", 4, 5, 6, 7) for i in range(8)], schema)
    found = resampled(docs, docs, percent=50)
    assert found.columns == docs.columns and found.count() == 4
    assert {tuple(r)[2:] for r in found.collect()} == {(1, 2, 3, "s", 4, 5, 6, 7)}
