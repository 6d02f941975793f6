"""Every stage's decision, on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from test_decontaminate import plain_overlap
from test_near_dedup import jaccard
from test_pii import plain_spans

from wiretally.llm.storage import durable

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_filter", "near_duplicates", "decontamination", "personal_data", "source_mix"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = durable(stage(spark, docs, SF_DIR), name)
        rows = docs.collect()
        kept[name] = {r.doc_id: r.text for r in rows}
        assert set(kept[name]) <= set(before)
        if name != "source_mix":
            assert docs.columns == columns and len(rows) == len(kept[name])
        if name == "near_duplicates":
            ids = sorted(before)
            alike = {(i, j): jaccard(before[i], before[j]) for k, j in enumerate(ids) for i in ids[:k]}
            assert not [p for p, x in alike.items() if x >= 0.9 and set(p) <= set(kept[name])]
            for gone in set(before) - set(kept[name]):
                assert max(x for p, x in alike.items() if gone in p) >= 0.5
        if name == "decontamination":
            short = {i for i, t in before.items() if len(t) < 3000}
            gone = {i for i in short if any(plain_overlap(before[i], x) for x in items)}
            assert short - set(kept[name]) == gone
        if name == "personal_data":
            assert set(kept[name]) == set(before)
            assert all(not plain_spans(t) for t in kept[name].values())
            assert all(t == before[i] for i, t in kept[name].items() if not plain_spans(before[i]))
        if name == "source_mix":
            positions = [r.position for r in rows]
            assert len(positions) == docs.count()
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted((r.doc_id, r.text) for r in whole.collect()) == sorted((r.doc_id, r.text) for r in rows)
