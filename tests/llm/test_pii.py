"""Spans against Python's own regular expressions, and contexts that find new identifiers."""

from __future__ import annotations

import hashlib
import re

from wiretally.llm import pii
from wiretally.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text: str | None) -> list[tuple[int, int, int]]:
    found = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),  # noqa: B023
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 10 <= len(digits) <= 15,  # noqa: B023
            }[kind]
            if fits():
                found.append((m.start(), no, m.end()))
    return sorted(found)


def as_text(spans) -> str:
    return ",".join(f"{pii.KINDS[no]}:{start}:{end}" for start, no, end in spans)


TRICKY = [
    None, "", "a@b.c@d.e", "x@y.z_q@r.s", "a@b", "@b.c", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.02.3.4x",
    "é 4111 1111 1111 1111 ü a@b.co", "4111-1111-1111-1112", "+1 (650) 555-1234, +12", "+1234567890123456",
    "9" * 5000, "a" * 5000 + "@", "+1 650 555 1234 +44 20 7946 0958", "00000000000000", "1.1.1.1@x.y",
    " ".join(f"10.0.{i}.{i % 300} u{i}@h.org" for i in range(700)), "\U0001f600 8.8.8.8 \U0001f600 q@w.e",
    "12 34 5678 9012 3456 78 +1.2.3.4.5.6.7.8.9.0 256.1.1.1 1..2.3.4",
]


def test_query_equals_plain_expressions(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries()["op10_personal_data"](spark, SF_DIR).collect()
    assert len(found) == len(docs)
    for r in found:
        expected = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(as_text(expected).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(no == k for _, no, _ in expected) for k in range(4)
        ]
        if expected:
            assert set(as_text(expected).split(",")) <= set(r.spans.split(","))


def test_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        assert [tuple(s) for s in r.base] == plain_spans(TRICKY[r.id]), TRICKY[r.id]


def test_contexts_find_what_the_patterns_miss(spark):
    rows = [(i, f"note {i} please call me at +1 650 555 {1000 + i} today") for i in range(12)]
    rows += [(100, "so please call me at 650-555-9999 today"), (101, "in room 650-555-9998 today or so")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r for r in pii.personal_data(docs).collect()}
    assert [tuple(s) for s in found[100].spans] == [(21, 3, 33)] and not found[100].base
    assert not found[101].spans
    assert all(found[i].spans == found[i].base and len(found[i].base) == 1 for i in range(12))


def test_copies_lend_no_support(spark):
    rows = [(i, "please call me at +1 650 555 1000 today") for i in range(30)]
    rows += [(100, "please call me at 650-555-9999 today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: len(r.spans) for r in pii.personal_data(docs).collect()}[100] == 0


def test_masking_keeps_rows_and_columns(spark):
    rows = [
        (1, "mail a@b.co or 10.0.0.1.", 24, "k"), (1, "mail a@b.co or 10.0.0.1.", 24, "k"), (2, None, None, "k"),
        (3, "", 0, "k"), (None, "x" * 100_000 + " q@w.e", 100_006, None), (4, "clean text", 10, "k"),
        (5, "+1.2.3.4.5.6.7.8.9.0", 20, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string")
    out = pii.mask_personal_data(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.collect() if r.text is not None)
    assert texts[0] == (0, "x" * 100_000 + " [EMAIL]", 100_008)
    assert texts[1] == texts[2] == (1, "mail [EMAIL] or [IP].", 21)
    assert texts[3:5] == [(3, "", 0), (4, "clean text", 10)]
    assert texts[5][1].startswith("[PHONE]")
    assert pii.mask_personal_data(docs.limit(0)).count() == 0


def test_contexts_hold_words_with_digits(spark):
    rows = [(i, f"line {i}: +1 650 555 {1000 + i} id{i + 10} due") for i in range(12)]
    rows += [(100, "line 2: 650-555-9999 id99 due"), (101, "\U0001f600" * 300 + " line 7: 650-555-9998 id98")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert found[100] == [(8, 3, 20)] and found[101] == [(309, 3, 321)]
    assert all(len(found[i]) == 1 for i in range(12))


def test_patterns_are_the_words_around(spark):
    text = "é " * 254 + "one t2: 650-555-9999, 2024-01-31 due " + "b " * 300 + "x3"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {s.value: (s.start, s.patterns) for s in pii.mentions(docs).first().candidates}
    at = text.index("650")
    assert found["650-555-9999"] == (at, ["one t0: _", "t0: _ ,"])
    assert found["2024-01-31"] == (text.index("2024"), ["t0: 000-000-0000, _", "000-000-0000, _ due"])
    assert found["x3"] == (len(text) - 2, ["b b _"])


def test_patterns_hold_whole_words_only(spark):
    text = "x" * 300 + " 650-555-9999 " + "y" * 300 + " a " + "z" * 50 + " 650-555-9998"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {s.value: s.patterns for s in pii.mentions(docs).first().candidates}
    assert found["650-555-9999"] == []
    assert found["650-555-9998"] == ["a " + "z" * 50 + " _"]
