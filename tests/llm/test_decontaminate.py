"""Overlaps against a plain alignment of every document with every item."""

from __future__ import annotations

import math
import random
import re
import time
from itertools import combinations

import pyarrow as pa
import pytest

from wiretally.llm import decontaminate
from wiretally.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def plain_overlap(text: str | None, item: str) -> bool:
    doc, own = WORD.findall((text or "").lower()), WORD.findall(item.lower())
    if len(own) < decontaminate.LEAST_WORDS:
        return False
    window = min(13, len(own))
    for start in range(-len(own) + 1, len(doc)):
        same = [doc[start + k] == w for k, w in enumerate(own) if 0 <= start + k < len(doc)]
        hits = [sum(same[i : i + window]) for i in range(len(same) - window + 1)]
        if max(hits, default=0) >= math.ceil(0.8 * window):
            return True
        if len(same) == len(own) and sum(same) >= 0.8 * len(own):
            return True
    return False


def test_query_equals_plain_alignment(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    expected = {
        (d.doc_id, i.item_id) for d in docs if d.n_chars < 4000 for i in items if plain_overlap(d.text, i.text)
    }
    short = {d.doc_id for d in docs if d.n_chars < 4000}
    found = queries()["op5_benchmark_decontamination"](spark, SF_DIR).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id in short} == expected
    assert expected


def _benchmark(spark, words: int = 20):
    return spark.createDataFrame([(7, " ".join(f"item{k}" for k in range(words)))], "item_id long, text string")


def test_substitutions_are_tolerated(spark):
    chance = random.Random(2)
    rows = []
    for n in range(60):
        own = [f"item{k}" for k in range(20)]
        for k in chance.sample(range(20), 4 if n % 2 else 12):
            own[k] = f"other{k}"
        rows.append((n, " ".join(["lead"] * (n % 7) + own + ["tail"] * (n % 5)).upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in decontaminate.benchmark_overlaps(docs, _benchmark(spark)).collect()}
    odd = {n for n, _ in rows if n % 2}
    assert len(found & odd) >= 0.97 * len(odd) and not found - odd


@pytest.mark.parametrize("n", range(5, 21))
def test_seeds_meet_every_overlap_that_is_promised(n):
    window = min(13, n)
    most = max(window - math.ceil(0.8 * window), n - math.ceil(0.8 * n))
    seeds = decontaminate.SEEDS if n < decontaminate.SHORT_WORDS else decontaminate.SEEDS[: decontaminate.LONG_SEEDS]
    for gone in combinations(range(n), most):
        assert any(all(s + k not in gone for k in seed) for seed in seeds for s in range(n - seed[-1]))


def test_short_items(spark):
    words = [f"item{k}" for k in range(12)]
    items, rows = [], []
    for n in range(5, 13):
        items.append((n, " ".join(words[-n:])))
        for gone in combinations(range(n), n - math.ceil(0.8 * n)):
            own = ["other" if k in gone else w for k, w in enumerate(words[-n:])]
            rows.append((len(rows), n, " ".join(["before", *own, "after"])))
    docs = spark.createDataFrame(rows, "doc_id long, n int, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_overlaps(docs, bench).collect()}
    assert found >= {(i, n) for i, n, _ in rows}
    assert found == {(i, n) for i, _, t in rows for n, item in items if plain_overlap(t, item)}


@pytest.mark.parametrize("many", [1, 1 << 16])
def test_repetitive_texts(monkeypatch, many):
    """Any number of equal words, and of equal alignments, with the plain result."""
    monkeypatch.setattr(decontaminate, "_MANY", many)
    chance = random.Random(9)
    items = ["a " * 30, "a b " * 20, "x y z " * 9 + "end", " ".join(chance.choices("ab", k=40))]
    texts = ["a " * 70, "b a " * 30, "z x y " * 12 + "end q", " ".join(chance.choices("ab", k=90)), "a b " * 3, ""]
    index = decontaminate.index_items(pa.array(range(4)), pa.array(items))
    found = {(row, item) for row, item, *_ in decontaminate.overlaps(pa.array(texts), index)}
    assert found == {(r, i) for r, t in enumerate(texts) for i, item in enumerate(items) if plain_overlap(t, item)}


def test_a_hundred_thousand_equal_words_take_seconds():
    index = decontaminate.index_items(pa.array([7]), pa.array(["a " * 50_000]))
    begun = time.time()
    assert list(decontaminate.overlaps(pa.array(["a " * 100_000]), index)) == [(0, 0, 50_000, 100_000, 50_000)]
    assert time.time() - begun < 30


def test_blocks_give_the_same_overlaps(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    whole = sorted(decontaminate.benchmark_overlaps(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(decontaminate.benchmark_overlaps(docs, items).collect()) == whole


def test_edge_rows(spark):
    item = " ".join(f"item{k}" for k in range(20))
    rows = [
        (1, None, 1), (2, "", 2), (3, item, 3), (3, item, 3), (None, "x " + item, 4),
        (5, "y " * 60_000 + item, 5), (6, "item3 item4", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = _benchmark(spark).unionAll(spark.createDataFrame([(8, None), (9, ""), (None, "x y")], "item_id long, text string"))
    found = decontaminate.benchmark_overlaps(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 7), (3, 7), (3, 7), (5, 7)]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.benchmark_overlaps(docs.limit(0), bench).count() == 0
