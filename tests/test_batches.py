"""Work per batch and per group does not grow with the number of segments."""

from __future__ import annotations

import __spark_entry__ as entry
from wire import log

from wiretally.session import use_rocksdb
from wiretally.streaming import stateful


def test_a_long_landing_takes_few_batches(spark, tmp_path):
    folder = tmp_path / "capture_id=1"
    folder.mkdir()
    for i in range(401):
        (folder / f"segment-{i:08d}.bin").write_bytes(log([b"x" * 40]))
        if i == 2:
            assert entry._files_at_once(spark, str(tmp_path)) == entry.FILES_AT_ONCE
    at_once = entry._files_at_once(spark, str(tmp_path))
    assert 401 <= at_once * entry.MOST_BATCHES < 401 + entry.MOST_BATCHES


def test_settled_hits_of_many_segments_share_few_groups(spark):
    rows = use_rocksdb(spark).range(0, 3000, 1, 2).selectExpr(
        "1 AS capture_id", "id DIV 3 * 1024 AS segment", "id DIV 3 * 1024 + id % 3 AS seq", "-id AS value"
    )
    runs, _ = stateful.edge_runs(rows, ["capture_id"], [], True, True)
    lanes = [r.lane for r in runs.where("lane != -1").collect()]
    assert len(lanes) == 2000 and set(lanes) <= set(range(stateful.LANES))
    assert runs.where("lane = -1").count() == 1000
