"""Random captures: the Spark jobs against what the captures hold by definition."""

from __future__ import annotations

import random

import pytest
from wire import RAW_SCHEMA, profile, random_capture, raw_rows

from wiretally.operators.headers import datagrams, decode_headers
from wiretally.operators.sequence import event_runs, event_sequence
from wiretally.operators.stats import packet_type_stats
from wiretally.plans.capture_summary import capture_summary
from wiretally.plans.interval_report import interval_report
from wiretally.sources.anchors import with_recv_ts

SECONDS = 2.0
START, STEP = 100.0, 0.25


@pytest.fixture(scope="module", params=[1, 2])
def captures(request):
    rng = random.Random(request.param)
    made = {c: random_capture(rng, n) for c, n in [(0, 400), (1, 90), (2, 1)]}
    made[3] = [b"abc"] * 5
    return made


@pytest.fixture(scope="module")
def raw(spark, captures):
    anchors = spark.createDataFrame(
        [(c, 1000 * 1_000_000) for c in captures], "capture_id int, anchor_us bigint"
    )
    return with_recv_ts(
        spark.createDataFrame(raw_rows(captures, START, STEP), RAW_SCHEMA), anchors
    ).cache()


@pytest.fixture(scope="module")
def expected(captures):
    return {
        c: profile(
            made,
            [START + i * STEP for i in range(len(made))],
            lambda now: int((now + 1000) // SECONDS),
        )
        for c, made in captures.items()
    }


@pytest.mark.parametrize("chunk_bits", [3, 20])
def test_type_stats(raw, expected, chunk_bits):
    got = {
        (r["capture_id"], r["packet_id"]): (r["n"], r["sizes"], r["backwards"], r["last_frame"])
        for r in packet_type_stats(decode_headers(raw), chunk_bits).collect()
    }
    want = {
        (c, p): (s["n"], sorted(s["sizes"]), s["back"], s["last"])
        for c, e in expected.items()
        for p, s in e["types"].items()
    }
    assert got == want


@pytest.mark.parametrize("chunk_bits", [3, 20])
def test_summary(spark, raw, expected, chunk_bits):
    manifest = spark.createDataFrame([(c,) for c in expected], "capture_id int")
    found = capture_summary(manifest, datagrams(raw), decode_headers(raw), chunk_bits).collect()
    assert len(found) == len(expected)
    for row in found:
        want = expected[row["capture_id"]]
        assert row["datagrams"] == want["datagrams"]
        assert row["runts"] == want["runts"]
        assert row["total_bytes"] == want["total_bytes"]
        if want["first"] is None:
            assert row["status"] == "no_packets"
            continue
        assert row["sessions"] == want["sessions"]
        first = ("packet_format", "game_year", "game_major", "game_minor", "player_car")
        assert tuple(row[f] for f in first) == want["first"]
        assert row["missing"] == ", ".join(want["missing"])
        assert row["event_runs"] == len(want["events"])


@pytest.mark.parametrize("bits", [3, 20])
def test_event_sequence(raw, expected, bits):
    parts = event_sequence(event_runs(decode_headers(raw), bits), bits).orderBy("capture_id", "part")
    found = {}
    for r in parts.collect():
        found.setdefault(r["capture_id"], []).append(r["sequence"])
    assert {c: " ".join(t) for c, t in found.items()} == {
        c: " ".join(e["events"]) for c, e in expected.items() if e["events"]
    }


@pytest.mark.parametrize("block_bits", [2, 12])
def test_interval_report(raw, expected, block_bits):
    found = interval_report(datagrams(raw), decode_headers(raw), SECONDS, block_bits).collect()
    got = {
        (r["capture_id"], r["window_index"], r["packet_id"]): (
            round(r["megabytes"] * 1e6),
            r["sessions"],
            r["total"],
            r["hz"],
            r["sizes"],
        )
        for r in found
    }
    want = {
        (c, w, p): (
            report["bytes"],
            report["sessions"],
            n,
            here / SECONDS,
            ",".join(map(str, sizes)),
        )
        for c, e in expected.items()
        for w, report in e["reports"].items()
        for p, (n, here, sizes) in report["types"].items()
    }
    assert len(found) == len(got)
    assert got == want


def test_invariants(raw, expected):
    stats = packet_type_stats(decode_headers(raw)).collect()
    for c, e in expected.items():
        n = sum(r["n"] for r in stats if r["capture_id"] == c)
        assert n + e["runts"] == e["datagrams"]
        assert all(a != b for a, b in zip(e["events"], e["events"][1:]))
