"""Held-out accuracy, and the parse against a plain search for longest matches."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from wiretally.llm import language
from wiretally.llm.queries import queries

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries()["op7_language_id"](spark, SF_DIR).collect()
    assert {r.doc_id for r in found} == set(truth)
    rest = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert len(rest) > 150 and sum(rest) / len(rest) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def plain_phrases(text: bytes, sample: bytes) -> int:
    """Longest stretches of ``text`` that occur in ``sample``, one after another over all of it."""
    total, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        total += 1
    return total


def test_parse_equals_plain_search():
    chance = random.Random(4)
    samples = tuple((name, bytes(chance.choices(letters, k=900))) for name, letters in (("x", b"abcd"), ("y", b"bcde "), ("z", b"aq")))
    squeeze = lambda b: b" ".join(b.split()) if b.strip() else b
    samples = tuple((name, squeeze(text)) for name, text in samples)
    own = language.parser(samples)
    texts = [squeeze(bytes(chance.choices(b"abcdeqz ", k=chance.randint(0, 700)))).strip() for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    # A row bound is no separator here: no text begins or ends with one.
    found = own.phrases(*language.symbols(data, offsets))
    assert found.tolist() == [[plain_phrases(t, s) for _, s in samples] for t in texts]


def test_edge_rows(spark):
    rows = [(k, w * 40, lang, 1) for k, (w, lang) in enumerate([("aab abba ", "aa"), ("xyx yyxz ", "xx")] * 4)]
    rows += [
        (20, None, "aa", 1), (21, "", "aa", 1), (22, "12 :; 34", "xx", 1), (23, "abba", None, 1),
        (23, "abba", None, 1), (None, "YXYX" * 50_000, None, 1), (24, "中文", None, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    samples = language.learned_samples(docs, F.lit(True))
    assert [name for name, _ in samples] == ["aa", "xx"]
    found = language.identified(docs, samples).collect()
    assert len(found) == len(rows)
    of = {}
    for r in found:
        of.setdefault(r.id, []).append((r.lang_pred, r.score))
    assert of[20] == of[21] == of[22] == [("und", 0.0)]
    assert [lang for lang, _ in of[23]] == ["aa", "aa"] and of[None][0][0] == "xx"
    assert of[24][0][0] in ("aa", "xx")
    assert {r.lang_pred for r in language.identified(docs, ()).collect()} == {"und"}
    assert language.identified(docs.limit(0), samples).count() == 0
    assert language.learned_samples(docs.limit(0), F.lit(True)) == ()


def test_parses_that_never_fall_into_step():
    """Of a periodic text, every stretch begins at another place of a phrase."""
    sample = b"aaaaaaa bbb ccccc"
    texts = [b"a" * 5000, b"b" * 3001, b"ab" * 2000, b"c" * 100, b"a" * 700 + b"b" * 900 + b"a" * 801]
    own = language.parser((("x", sample), ("y", b"abab aab")))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = own.phrases(*language.symbols(np.frombuffer(b"".join(texts), np.uint8), offsets))
    assert found.tolist() == [[plain_phrases(t, sample), plain_phrases(t, b"abab aab")] for t in texts]


def test_every_language_is_learned(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} " * 80, f"l{k:04}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.learned_samples(docs, F.lit(True))
    assert [name for name, _ in samples] == sorted(r[2] for r in rows)
    assert all(language.LEAST_CHARS <= len(text) <= 200 for _, text in samples)
    some = docs.where("doc_id % 100 = 7")
    assert all(r.lang_pred == f"l{r.id:04}" for r in language.identified(some, samples).collect())
