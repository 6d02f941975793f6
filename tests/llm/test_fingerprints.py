"""Fingerprints against plain votes, and the edited texts against plain strings."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa

from wiretally.llm import fingerprints
from wiretally.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def _mix(h: int) -> int:
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & M
    return h ^ (h >> 31)


def _word(word: bytes) -> int:
    total = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word))
    return _mix((total + len(word) * 0xD6E8FEB86659FD93) & M)


def plain_fingerprint(text: str | None, width: int = 3) -> int:
    words = [_word(w) for w in (text or "").encode().lower().split()]
    terms: Counter[int] = Counter()
    for i in range(max(len(words) - width + 1, min(1, len(words)))):
        total = 0
        for w in words[i : i + width]:
            total = (total * 0x9FB21C651E98DF25 + w) & M
        terms[_mix(total)] += 1
    weight = {t: round(8 + 8 * math.log2(n)) for t, n in terms.items()}
    return sum(
        1 << b for b in range(64) if sum(w if t >> b & 1 else -w for t, w in weight.items()) > 0
    )


def expected(docs: dict) -> dict:
    order = sorted(docs, reverse=True)
    found = {}
    for k, i in enumerate(order):
        own, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        n = len(own) // 3
        edited = own[: len(own) - n] + after[:n]
        a, b, c = (plain_fingerprint(t) for t in (own, edited, after))
        near = lambda x, y: 1 - (x ^ y).bit_count() / 64
        sha = hashlib.sha256(edited.encode()).hexdigest()
        found[i] = (len(own), sha, f"{a:016x}", f"{b:016x}", near(a, b), near(a, c))
    return found


def test_query_equals_plain_votes(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items()}
    found = queries()["op1_document_fingerprints"](spark, SF_DIR).collect()
    assert len(found) == len(docs)
    assert {r.doc_id: tuple(r)[1:7] for r in found} == expected(docs)
    fps = {r.doc_id: int(r.fingerprint, 16) for r in found}
    near = {i: sum((x ^ y).bit_count() <= 3 for y in fps.values()) for i, x in fps.items() if i % 20 == 0}
    assert {r.doc_id: r.n_near for r in found if r.n_near is not None} == near


def test_edge_rows(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(70_000))
    texts = {5: "é" * 7, 4: None, 3: "", 2: long_text, 1: "one two", -4: "\U0001f600 x " * 5, 9: long_text}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.id: tuple(r)[1:] for r in fingerprints.edit_fingerprints(docs.repartition(3)).collect()}
    assert found == expected(texts)
    assert found[2][2] == found[9][2]
    assert fingerprints.edit_fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.edit_fingerprints(docs.where("doc_id = 1")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"one ton").hexdigest()


def test_repeated_and_null_ids(spark):
    rows = [(2, "b b b b b b"), (2, "a a a a a a"), (2, "a a a a a a"), (None, "n n n"), (1, "c c c c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprints.edit_fingerprints(docs).count() == 5
    none = spark.createDataFrame([(None, "abc"), (None, "xyz")], "doc_id long, text string")
    assert fingerprints.edit_fingerprints(none).count() == 2


def test_fingerprint_does_not_depend_on_the_batch():
    texts = [" ".join(f"w{i % k}" for i in range(3000)) for k in range(5, 60)]
    alone = [int(fingerprints.fingerprint_texts(pa.array([t]))[0]) for t in texts]
    assert fingerprints.fingerprint_texts(pa.array(texts)).tolist() == alone


def test_block_tables_find_all_within_the_radius(spark):
    chance = random.Random(3)
    base = [chance.getrandbits(64) for _ in range(40)]
    known = set(base)
    for x in base:
        for flips in range(1, 7):
            y = x
            for b in chance.sample(range(64), flips):
                y ^= 1 << b
            known.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in sorted(known)] * 2, "fp long")
    asked = spark.createDataFrame([(signed(x),) for x in base] + [(None,)], "fp long")
    truth = {
        (signed(x), signed(y), (x ^ y).bit_count()) for x in base for y in known if (x ^ y).bit_count() <= 3
    }
    for blocks in (None, 4, 6):
        found = fingerprints.within_radius(asked, table, 3, blocks)
        assert {tuple(r) for r in found.collect()} == truth
