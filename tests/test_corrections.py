"""Segments in any landing order end in the batch answer."""

from __future__ import annotations

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from wire import log, random_capture

from wiretally.operators import sequence
from wiretally.operators.headers import decode_headers
from wiretally.sources.archive import write_archive
from wiretally.sources.captures import read_captures, read_packets
from wiretally.streaming.corrections import (
    RelinkEdges,
    latest_changes,
    stream_event_run_changes,
    stream_reversal_changes,
)
from wiretally.streaming.ingest import stream_captures, stream_from_archive
from wiretally.streaming.results import run_appending
from wiretally.streaming.stateful import EDGE_LANE

SEGMENT = 30
CHANGES = {"rev": stream_reversal_changes, "runs": stream_event_run_changes}
BATCH = {"rev": sequence.reversals, "runs": sequence.event_runs}


class Held:
    """State of one key, kept in memory."""

    def __init__(self):
        self.value, self.entries = None, {}

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, keys, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        del self.entries[key]


def plain(values: list[int], drops_only: bool, starts_count: bool) -> dict[int, int | None]:
    found = {0: None} if starts_count and values else {}
    for i in range(1, len(values)):
        if values[i] < values[i - 1] if drops_only else values[i] != values[i - 1]:
            found[i] = values[i - 1]
    return found


def fed(processor, runs, batches):
    """The newest change of each record, after runs ``(seq, values)`` went in, some at a time."""
    newest = {}
    for batch in batches:
        rows = [
            (1, s, v[0], EDGE_LANE, 0, s + len(v) - 1, v[-1]) for s, v in (runs[i] for i in batch)
        ]
        columns = ["capture_id", "seq", "value", "lane", "prev", "tail_seq", "tail_value"]
        edges = pd.DataFrame(rows, columns=columns)
        seen = set()
        for out in processor.handleInputRows((1, EDGE_LANE), iter([edges]), None):
            for r in out.itertuples(index=False):
                assert r.seq not in seen
                seen.add(r.seq)
                newest[r.seq] = (r.holds, r.prev if r.has_prev else None, r.out_of_order)
    return newest


@pytest.mark.parametrize("drops_only, starts_count", [(True, False), (False, True)])
@pytest.mark.parametrize("seed", range(30))
def test_any_order_of_runs_links_as_the_whole(seed, drops_only, starts_count):
    rng = random.Random(seed)
    values = [rng.randrange(4) for _ in range(rng.choice([1, 5, 60, 300]))]
    runs, at = [], 0
    while at < len(values):
        n = rng.choice([1, 1, 2, 7, 40])
        runs.append((at, values[at : at + n]))
        at += n
    order = list(range(len(runs)))
    rng.shuffle(order)
    batches = []
    while order:
        n = rng.choice([1, 2, 5])
        batches.append(order[:n])
        order = order[n:]
    processor = RelinkEdges(["capture_id"], {}, starts_count, drops_only, None, rng.choice([0, 2, 4, 16]))
    processor.init(Held())
    processor.runs, processor.facts = Held(), Held()
    newest = fed(processor, runs, batches)
    heads = {s for s, _ in runs}
    want = {i: p for i, p in plain(values, drops_only, starts_count).items() if i in heads}
    assert {i: p for i, (holds, p, _) in newest.items() if holds} == want
    assert not any(flagged for _, _, flagged in newest.values())
    stored = [s for block in processor.runs.entries.values() for s in block[0]]
    assert sorted(stored) == sorted(heads)


def test_a_bounded_state_forgets_and_flags():
    runs = [(i * 10, [5, 4]) for i in range(100)]
    processor = RelinkEdges(["capture_id"], {}, False, True, 200, 4)
    processor.init(Held())
    processor.runs, processor.facts = Held(), Held()
    in_order = [[i] for i in range(100) if i not in (3, 97)]
    newest = fed(processor, runs, [*in_order, [97], [3]])
    assert len(processor.runs.entries) <= 200 // 16 + 2
    assert newest[30] == (True, None, True)  # landed 960 records late: kept, but flagged
    assert 970 not in newest and not any(holds for i, (holds, _, _) in newest.items() if i != 30)


def test_a_record_that_comes_twice_is_an_error():
    processor = RelinkEdges(["capture_id"], {}, False, True, None)
    processor.init(Held())
    processor.runs, processor.facts = Held(), Held()
    with pytest.raises(ValueError, match="once"):
        fed(processor, [(0, [1, 2, 3]), (2, [9])], [[0], [1]])


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def land(folder, capture, made, first, when):
    target = folder / f"capture_id={capture}"
    target.mkdir(parents=True, exist_ok=True)
    path = target / f"segment-{first:08d}.bin"
    path.write_bytes(log(made[first : first + SEGMENT], start=100.0 + first * 0.25))
    os.utime(path, (when, when))


def shuffled_landing(folder, seed, captures=(1, 2), records=250):
    rng = random.Random(seed)
    made = {c: [d for d in random_capture(rng, records) if d] for c in captures}
    parts = [(c, first) for c in captures for first in range(0, len(made[c]), SEGMENT)]
    rng.shuffle(parts)
    for i, (c, first) in enumerate(parts):
        land(folder, c, made[c], first, 1_700_000_000 + i)
    return str(folder)


@pytest.mark.parametrize("files", [3, 1000])
@pytest.mark.parametrize("kind", CHANGES)
def test_shuffled_segments_end_in_the_batch_answer(spark, tmp_path, kind, files):
    landing = shuffled_landing(tmp_path / "landing", 21)
    live = stream_captures(spark, landing, "int", files, headers_only=True)
    changes = run_appending(CHANGES[kind](live, block_bits=5), "t", str(tmp_path / "work"))
    batch = BATCH[kind](read_packets(spark, landing, "int"))
    found = latest_changes(changes)
    assert found.where("out_of_order").count() == 0
    same(found.drop("out_of_order"), batch)
    if files == 3:
        assert changes.where("NOT holds").count() > 0  # something was taken back


def test_late_segments_after_a_restart(spark, tmp_path):
    made = [d for d in random_capture(random.Random(8), 200) if d]
    for i, first in enumerate((2 * SEGMENT, 0, SEGMENT, 3 * SEGMENT)):
        land(tmp_path / "landing", 1, made, first, 1_700_000_000 + i)
        live = stream_captures(spark, str(tmp_path / "landing"), "int", headers_only=True)
        packets = read_packets(spark, str(tmp_path / "landing"), "int")
        for kind, changes in CHANGES.items():
            found = latest_changes(run_appending(changes(live), "t", str(tmp_path / kind)))
            same(found.drop("out_of_order"), BATCH[kind](packets))


def test_packets_in_no_order_at_all(spark, tmp_path):
    landing = shuffled_landing(tmp_path / "landing", 5, captures=(1,))
    archive = str(tmp_path / "archive")
    raw = read_captures(spark, landing, "int")
    odd = F.col("seq") % 2 == 1
    for part in (raw.where(odd), raw.where(~odd)):
        write_archive(part.orderBy(F.rand(1)), archive)
    live = decode_headers(stream_from_archive(spark, archive, 1))
    changes = run_appending(stream_reversal_changes(live, in_order=False), "t", str(tmp_path / "rev"))
    same(latest_changes(changes).drop("out_of_order"), sequence.reversals(read_packets(spark, landing, "int")))
