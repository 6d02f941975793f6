"""The live interval report and logs that grow, against the batch answers."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from test_streaming import SEGMENT, anchors, land, same
from wire import log, random_capture

from wiretally.operators.headers import decode_headers
from wiretally.plans.interval_report import interval_report
from wiretally.sources.anchors import with_recv_ts
from wiretally.sources.captures import read_captures
from wiretally.sources.growing import stream_growing_captures
from wiretally.streaming.ingest import stream_captures
from wiretally.streaming.reports import (
    COUNT,
    FIRST,
    SESSION,
    SIZE,
    IntervalReports,
    latest_reports,
    stream_interval_report,
)
from wiretally.streaming.results import run_appending

SECONDS = 3.0


@pytest.mark.parametrize("files", [2, 1000])
def test_any_landing_order_ends_in_the_batch_report(spark, tmp_path, files):
    rng = random.Random(23)
    landing = tmp_path / "landing"
    made = {c: [d for d in random_capture(rng, 240) if d] for c in (1, 2)}
    segments = [(c, i) for c in made for i in range(0, len(made[c]), SEGMENT)]
    rng.shuffle(segments)
    for k, (c, i) in enumerate(segments):
        land(landing, c, made[c], i, 1_700_000_000 + k)
    live = with_recv_ts(stream_captures(spark, str(landing), "int", files), anchors(spark))
    found = run_appending(stream_interval_report(live, SECONDS), "t", str(tmp_path / "out"))
    raw = with_recv_ts(read_captures(spark, str(landing), "int"), anchors(spark))
    packets = with_recv_ts(decode_headers(read_captures(spark, str(landing), "int")), anchors(spark))
    expected = interval_report(raw, packets, SECONDS)
    assert expected.count() > 100
    same(latest_reports(found), expected)
    assert (found.agg({"revision": "max"}).first()[0] > 1) == (files == 2)


class Memory:
    """State as the operator sees it, in a dict."""

    def __init__(self):
        self.held = {}

    def get(self):
        return self.held.get(())

    def update(self, value):
        self.held[()] = value

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)

    def iterator(self):
        return iter(list(self.held.items()))


class Operator:
    def __init__(self, **settings):
        self.now, self.timers, self.rows = 0, [], {}
        self.own = IntervalReports(1_000_000, settings.get("keep"), settings.get("idle"))
        self.own.init(SimpleNamespace(
            getValueState=lambda *_: Memory(), getMapState=lambda *_: Memory(), registerTimer=self.timers.append
        ))
        self.times = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: self.now)

    def _take(self, frames):
        rows = [r for f in frames for r in f.itertuples(index=False)]
        self.rows.update({(r.window_index, r.packet_id): r for r in rows})
        return rows

    def send(self, *packets):
        """Packets as ``(seq, window, type, size, session)``."""
        parts = []
        for seq, w, packet_id, size, session in packets:
            parts += [
                (COUNT, w, packet_id, 0, None, 1, size, 0, 0), (SIZE, w, packet_id, size, None, 0, 0, 0, 0),
                (SESSION, w, 0, 0, session, 0, 0, 0, 0), (FIRST, w, 0, 0, None, 0, 0, seq, w * 1_000_000),
            ]
        names = ["kind", "window_index", "packet_id", "size", "session", "n", "bytes", "seq", "started"]
        return self._take(self.own.handleInputRows((1,), iter([pd.DataFrame(parts, columns=names)]), self.times))

    def tick(self, seconds):
        self.now = int(seconds * 1000)
        return self._take(self.own.handleExpiredTimer((1,), self.times, None))


def test_silent_types_and_intervals_are_reported():
    op = Operator()
    op.send((0, 10, 3, 40, "a"), (1, 10, 5, 50, "a"))
    op.send((2, 14, 3, 41, "b"))
    assert {w: (op.rows[w, 3].n, op.rows[w, 3].total) for w in range(10, 15)} == {
        10: (1, 1), 11: (0, 1), 12: (0, 1), 13: (0, 1), 14: (1, 2)
    }
    assert all(op.rows[w, 5].total == 1 and op.rows[w, 5].n == (w == 10) for w in range(10, 15))
    assert [op.rows[w, 3].sessions for w in range(10, 15)] == [1, 1, 1, 1, 2]
    assert op.rows[14, 3].seen_sizes == [40, 41] and op.rows[13, 3].seen_sizes == [40]
    assert [op.rows[w, 3].is_partial for w in range(10, 15)] == [False] * 4 + [True]


def test_late_packets_correct_what_was_reported():
    op = Operator()
    op.send((5, 10, 3, 40, "a"))
    op.send((6, 13, 3, 40, "b"))
    changed = op.send((4, 8, 3, 30, "b"))
    assert {r.window_index for r in changed} == set(range(8, 14))
    assert [op.rows[w, 3].total for w in range(8, 14)] == [1, 1, 2, 2, 2, 3]
    assert [op.rows[w, 3].sessions for w in range(8, 14)] == [1, 1, 2, 2, 2, 2]
    assert op.rows[13, 3].uptime == 6.0 and op.rows[8, 3].bytes_total == 30


def test_state_is_bounded_by_the_windows_kept():
    op = Operator(keep=3)
    for w in range(10, 60):
        op.send((w, w, 3, 40, "a"))
    assert len(op.own.cells.held) <= 4 and len(op.own.whole.held) <= 4
    changed = op.send((0, 20, 3, 40, "a"))
    assert {r.window_index for r in changed} == set(range(56, 60))
    assert [op.rows[w, 3].total for w in range(56, 60)] == [48, 49, 50, 51] and op.rows[56, 3].n == 1


def test_timers_report_silence_until_a_capture_is_idle():
    op = Operator(idle=5)
    op.now = 10_500
    op.send((0, 10, 3, 40, "a"))
    assert op.timers == [11_500]
    assert [(r.window_index, r.n, r.total) for r in op.tick(12.5)] == [(10, 1, 1), (11, 0, 1)]
    assert [r.window_index for r in op.tick(30)] == [11, 12, 13, 14, 15] and len(op.timers) == 2
    op.now = 31_000
    op.send((1, 13, 3, 40, "a"), (2, 31, 3, 40, "a"))
    assert (op.rows[13, 3].n, op.rows[13, 3].total, op.rows[15, 3].total, op.rows[31, 3].total) == (1, 2, 2, 3)


def run(spark, folder, most=1 << 20, kind="string"):
    live = stream_growing_captures(spark, f"{folder}/logs", f"{folder}/progress", kind, most)
    return run_appending(live, "t", f"{folder}/out")


def test_a_log_that_grows_is_read_once(spark, tmp_path):
    """At any length, a few bytes at a time, and with a restart after each step."""
    made = [d for d in random_capture(random.Random(5), 120) if d]
    whole = log(made, start=100.0)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "empty.bin").write_bytes(b"")
    for upto in (5, 700, 701, len(whole) // 2, len(whole)):
        (logs / "one.bin").write_bytes(whole[:upto])
        found = run(spark, tmp_path)
        assert found.where("error IS NOT NULL").count() == 0
    same(found, read_captures(spark, str(logs)))
    assert run(spark, tmp_path).count() == len(made)
    notes = [p for p in (tmp_path / "progress").rglob("*.json")]
    assert len(notes) <= 3


def test_a_trigger_is_bounded_and_damage_ends_a_log(spark, tmp_path):
    made = [d for d in random_capture(random.Random(6), 60) if d]
    folder = tmp_path / "logs" / "capture_id=7"
    folder.mkdir(parents=True)
    data = log(made, start=100.0) + b"\xff" * 50 + log(made[:3])
    path = folder / "segment-00000000000000000100.bin"
    path.write_bytes(data)
    counts = [run(spark, tmp_path, len(data) // 3, "int").count() for _ in range(4)]
    assert 0 < counts[0] < counts[1] < counts[2] <= counts[3]
    path.write_bytes(data + log(made))
    same(run(spark, tmp_path, 1 << 20, "int"), read_captures(spark, str(tmp_path / "logs"), "int"))


def test_a_task_sends_each_window_and_session_once(spark):
    from wiretally.streaming import reports

    rows = spark.range(0, 30_000, 1, 1).selectExpr(
        "1 AS capture_id", "id DIV 10000 AS window_index", "id AS seq", "60 AS size",
        "cast(id % 2 AS int) AS packet_id", "cast(id % 7 AS string) AS session", "id * 1000 AS started",
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        sent = reports._parts(rows, "int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    kinds = {k: [r for r in sent if r.kind == k] for k in range(4)}
    assert [len(kinds[k]) for k in range(4)] == [6, 2, 7, 1]
    assert all(r.n == 5000 and r.bytes == 300_000 for r in kinds[reports.COUNT])
    assert all(r.window_index == 0 for r in kinds[reports.SESSION]) and kinds[reports.FIRST][0].seq == 0
