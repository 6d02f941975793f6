"""Exact duplicates against grouping by the text itself."""

from __future__ import annotations

import pytest

from wiretally.llm import exact_dedup
from wiretally.llm.exact_dedup import drop_exact_duplicates, exact_groups, repeated_facts

SCHEMA = "doc_id long, text string"
START = "The same beginning, longer than what is hashed of a text before all of it is. "
TEXTS = [
    "", None, "a", "a", "b", START + "x", START + "x", START + "y", START + "zz", "é" * 40, "é" * 40, "e" * 80,
    "long " * 200_000, "long " * 200_000, "long " * 199_999 + "lonG ", "only one of its length, surely",
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)]


def plain_groups(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    known = lambda ids: [i for i in ids if i is not None]
    return {t: (max(known(ids), default=None), len(ids)) for t, ids in groups.items()}


def check(spark, docs, **how):
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    rows = exact_groups(frame, carried={"t": frame["text"]}, **how).collect()
    expected = plain_groups(docs)
    assert sorted((r.id is None, r.id, r.t or "") for r in rows) == sorted((i is None, i, t or "") for i, t in docs)
    for r in rows:
        assert (r.keep_id, r.group_size) == expected[r.t or ""]
    kept = [(r.id, r.t or "") for r in rows if r.kept]
    assert sorted(t for _, t in kept) == sorted(expected)
    assert all(i == expected[t][0] for i, t in kept)
    left = drop_exact_duplicates(frame, **how).collect()
    assert sorted((r.text or "") for r in left) == sorted(expected)
    assert all(r.doc_id == expected[r.text or ""][0] for r in left)


@pytest.mark.parametrize("bits", [1 << 15, exact_dedup.FILTER_BITS])
def test_equals_plain_grouping(spark, bits):
    check(spark, DOCS, bits=bits)


@pytest.mark.parametrize("share", [1, 1000])
def test_hot_and_cold_groups(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    check(spark, DOCS + [(100 + i, "copy") for i in range(50)] + [(200 + i, f"pair {i // 2}") for i in range(40)])


def test_repeated_ids_and_null_ids(spark):
    check(spark, [(1, "t")] * 3 + [(None, "t"), (None, "u"), (None, "u"), (1, "v"), (1, "w"), (None, "")])


def test_only_survivors_are_hashed_in_full(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    hashed = {r.id for r in exact_groups(docs).collect() if r.full is not None}
    # Alike by length and beginning: the last of them differ only further on.
    assert hashed == {0, 1, 2, 3, 5, 6, 7, 9, 10, 12, 13, 14}
    by_size, by_start = repeated_facts(docs)
    assert by_size.count() <= exact_dedup.FILTER_BITS >> 15 and by_start.count() <= exact_dedup.FILTER_BITS >> 15


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0
    schema = SCHEMA + ", id int, row int, full string, size int, _mark int, _key int, _part int, _bitmap int, _same_size int, `a.b` int"
    docs = spark.createDataFrame([(i, "same" if i else "other", *[k if k != 2 else "s" for k in range(10)]) for i in range(6)], schema)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r) for r in left.collect()) == sorted(tuple(r) for r in docs.where("doc_id IN (0, 5)").collect())
    assert exact_groups(docs).count() == 6


def test_stays_in_the_jvm(spark):
    plan = drop_exact_duplicates(spark.createDataFrame(DOCS, SCHEMA).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
