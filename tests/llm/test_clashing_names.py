"""Every operator that hands documents on keeps columns of any name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wiretally.llm import decontaminate, exact_dedup, mixing, near_dedup, pii, quality, resampling

NAMES = [
    "id", "text_hash", "_ROW_KEY", "__row_key", "_lowered", "_spans", "_position", "_key", "row", "node", "keep",
    "label", "good", "p", "size", "key", "part", "at", "a.b", "`q`",
]
ITEM = " ".join(f"item{k}" for k in range(20))


def _documents(spark):
    texts = ["plain words of a clean text " * 4, "mail a@b.co or call", ITEM, "plain words of a clean text " * 4, "", None]
    rows = [(i, t, f"s{i % 2}", "en", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, {quoted}")


def _labels(spark):
    return spark.createDataFrame([(0, 1), (1, 1), (2, 1), (4, 0)], "doc_id long, quality int")


STAGES = {
    "quality": lambda s, d: quality.drop_low_quality(d, _labels(s), F.col("source"), F.col("lang")),
    "near": lambda s, d: near_dedup.drop_near_duplicates(d),
    "exact": lambda s, d: exact_dedup.drop_exact_duplicates(d),
    "benchmark": lambda s, d: decontaminate.drop_contaminated(d, s.createDataFrame([(1, ITEM)], "item_id long, text string")),
    "personal": lambda s, d: pii.mask_personal_data(d),
    "resampled": lambda s, d: resampling.resampled(d, d, percent=100, least_words=0),
    "mixed": lambda s, d: mixing.mixed(d).drop("position"),
}


@pytest.mark.parametrize("name", STAGES)
def test_columns_come_through(spark, name):
    docs = _documents(spark)
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows or name == "quality"
    for r in rows:
        assert tuple(r)[4:] == tuple(f"{n}{r.doc_id}" for n in NAMES)
    if name == "personal":
        assert len(rows) == 6 and {r.text for r in rows if r.doc_id == 1} == {"mail [EMAIL] or call"}
    if name == "benchmark":
        assert {r.doc_id for r in rows} == {0, 1, 3, 4, 5}
    if name in ("near", "exact"):
        assert len(rows) == 4
