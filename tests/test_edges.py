"""Edge captures with answers worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from wire import RAW_SCHEMA, datagram, raw_rows

from wiretally.functions import header_field
from wiretally.layout import HEADER_FIELDS
from wiretally.operators import names, rates, sequence, stats
from wiretally.operators.headers import datagrams, decode_headers
from wiretally.plans.capture_summary import capture_summary
from wiretally.plans.interval_report import interval_report
from wiretally.plans.type_summary import flashbacks, type_summary
from wiretally.sources.anchors import with_recv_ts

BIG_SESSION, BIG_FRAME = 2**64 - 1, 2**32 - 1


@pytest.fixture
def raw(spark):
    def make(captures, **clock):
        return spark.createDataFrame(raw_rows(captures, **clock), RAW_SCHEMA)

    return make


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def by_type(packets, chunk_bits=20):
    return {
        r["packet_id"]: r for r in stats.packet_type_stats(packets, chunk_bits).collect()
    }


def test_sizes_28_and_29(raw):
    df = raw({1: [datagram(size=28), datagram(size=29)]})
    assert rows(stats.capture_totals(datagrams(df))) == [(1, 2, 1, 57, 57 / 1e6)]
    assert decode_headers(df).count() == 1


def test_empty_datagram_leaves_no_trace(raw):
    df = raw({1: [b"", datagram()]})
    assert rows(stats.capture_totals(datagrams(df))) == [(1, 1, 0, 29, 29 / 1e6)]


def test_a_long_datagram_is_kept_whole(raw):
    kept = datagrams(raw({1: [datagram(size=5000)]}))
    assert rows(kept.select("size", F.octet_length("payload"))) == [(5000, 5000)]


def test_event_code_needs_33_bytes(raw):
    df = decode_headers(raw({1: [datagram(3, size=s, code=b"SSTA") for s in (32, 33)]}))
    assert rows(df.select("size", "event_code"), "size") == [(32, None), (33, "SSTA")]
    assert sequence.event_packets(df).count() == 1


def test_only_event_packets_have_a_code(raw):
    df = decode_headers(raw({1: [datagram(2, size=40, code=b"SSTA")]}))
    assert rows(df.select("event_code")) == [(None,)]


def test_code_bytes_outside_ascii(raw, spark):
    df = raw({1: [datagram(3, size=33, code=b"\xff\x00AB")]})
    assert rows(decode_headers(df).select("event_code")) == [("�\x00AB",)]
    from wiretally.functions import event_code

    assert rows(df.select(event_code(F.col("payload")))) == [("�\x00AB",)]


def test_code_key_is_one_to_one(raw):
    codes = [b"\xffABC", b"A\xffBC", b"AB\xffC", b"ABC\xff", b"ABC\x00", b"\x00ABC", b"ABCA"]
    df = decode_headers(raw({1: [datagram(3, size=33, code=c) for c in codes]}))
    assert sequence.event_runs(df).count() == len(codes)
    from wiretally.functions import event_code_key

    assert df.select(event_code_key(F.col("event_code"))).distinct().count() == len(codes)


@pytest.mark.parametrize(
    "frames, expected", [([5, 5, 4, 6], 1), ([1000, 500, 600, 900], 1), ([1, 2, 3], 0)]
)
@pytest.mark.parametrize("chunk_bits", [0, 1, 20])
def test_reversals_compare_with_the_previous_frame(raw, frames, expected, chunk_bits):
    df = decode_headers(raw({1: [datagram(0, f) for f in frames]}))
    assert by_type(df, chunk_bits)[0]["backwards"] == expected
    assert sequence.reversals(df, chunk_bits).count() == expected


@pytest.mark.parametrize("chunk_bits", [0, 1, 20])
def test_interleaved_types_do_not_mix(raw, chunk_bits):
    df = decode_headers(
        raw({1: [datagram(t, f) for t, f in [(0, 10), (2, 1), (0, 11), (2, 2), (0, 12)]]})
    )
    assert [s["backwards"] for s in by_type(df, chunk_bits).values()] == [0, 0]


def test_a_new_session_restart_counts(raw):
    df = decode_headers(
        raw({1: [datagram(0, 50, session=1), datagram(2, 9, session=1), datagram(0, 0, session=2)]})
    )
    assert {p: s["backwards"] for p, s in by_type(df).items()} == {0: 1, 2: 0}


@pytest.mark.parametrize("chunk_bits", [0, 1, 20])
def test_event_runs_collapse_across_sessions(raw, chunk_bits):
    made = [
        datagram(3, size=33, code=c, session=s, time=t)
        for c, s, t in [(b"AAAA", 1, 1), (b"AAAA", 2, 2), (b"BBBB", 2, 3), (b"AAAA", 2, 4)]
    ]
    made.insert(2, datagram(0))
    df = decode_headers(raw({1: made}))
    runs = sequence.event_runs(df, chunk_bits)
    assert rows(runs.select("seq", "code", "session_time"), "seq") == [
        (0, "AAAA", 1.0),
        (3, "BBBB", 3.0),
        (4, "AAAA", 4.0),
    ]
    assert rows(sequence.event_sequence(runs).select("part", "sequence")) == [
        (0, "AAAA BBBB AAAA")
    ]
    parts = sequence.event_sequence(runs, part_bits=2)
    assert rows(parts.select("part", "sequence"), "part") == [(0, "AAAA BBBB"), (1, "AAAA")]


def test_unknown_type_names(raw):
    df = decode_headers(raw({1: [datagram(200, 5), datagram(200, 4)]}))
    assert rows(type_summary(df).select("packet_name")) == [("UNKNOWN",)]
    assert rows(flashbacks(df).select("packet_name", "backwards")) == [("200", 1)]


def test_extreme_header_values(raw):
    df = raw({1: [datagram(255, BIG_FRAME, session=BIG_SESSION, overall=BIG_FRAME)]})
    packet = decode_headers(df).collect()[0]
    assert int(packet["session_uid"]) == BIG_SESSION
    assert (packet["frame_id"], packet["overall_frame_id"]) == (BIG_FRAME, BIG_FRAME)
    assert (packet["packet_id"], packet["secondary_car"]) == (255, 255)


def test_session_times_survive(raw):
    times = [math.nan, math.inf, -math.inf, -0.0, 1e-40, 1.5, -3.25, 3.4e38]
    df = raw({1: [datagram(time=t) for t in times]})
    for source in (
        decode_headers(df).select("seq", "session_time"),
        df.select("seq", header_field(F.col("payload"), "session_time").alias("session_time")),
    ):
        got = [r["session_time"] for r in source.orderBy("seq").collect()]
        assert math.isnan(got[0])
        assert got[1:3] == [math.inf, -math.inf]
        assert got[3] == 0.0 and math.copysign(1, got[3]) == -1
        assert got[4] == pytest.approx(1e-40, rel=1e-4)
        assert got[5:7] == [1.5, -3.25]
        assert got[7] == pytest.approx(3.4e38, rel=1e-6)


def test_native_fields_equal_the_batch_decode(raw):
    df = raw({1: [datagram(i % 256, i * 977, session=2**63 + i, time=i / 3) for i in range(300)]})
    native = df.select(*[header_field(F.col("payload"), f).alias(f) for f in HEADER_FIELDS])
    decoded = decode_headers(df).select(*HEADER_FIELDS)
    assert native.schema.simpleString() == decoded.schema.simpleString()
    assert native.exceptAll(decoded).count() == 0


@pytest.mark.parametrize("formats, ok", [((2022, 2023), False), ((2023, 2022), True)])
def test_format_check_looks_at_the_first_packet(raw, formats, ok):
    df = decode_headers(raw({1: [datagram(packet_format=f) for f in formats]}))
    assert rows(stats.first_packet(df).select("format_ok")) == [(ok,)]
    assert by_type(df)[0]["n"] == 2


def test_sizes_sort_as_numbers(raw):
    df = decode_headers(raw({1: [datagram(size=s) for s in (100, 29, 1349, 100)]}))
    assert rows(type_summary(df).select("sizes")) == [("29,100,1349",)]
    assert rows(stats.packet_sizes(df).select("sizes")) == [([29, 100, 1349],)]


def test_missing_types(raw):
    df = decode_headers(raw({1: [datagram(t) for t in range(13)], 2: [datagram(size=5)]}))
    assert rows(names.missing_types(df).select("capture_id", "packet_name")) == [(1, "MotionEx")]


def summary_of(spark, raw_df, captures):
    manifest = spark.createDataFrame([(c,) for c in captures], "capture_id int")
    found = capture_summary(manifest, datagrams(raw_df), decode_headers(raw_df))
    return {r["capture_id"]: r for r in found.collect()}


def test_no_packets_status(spark, raw):
    df = raw({1: [datagram(size=5)], 2: [datagram()]})
    found = summary_of(spark, df, [0, 1, 2])
    assert [found[c]["status"] for c in (0, 1, 2)] == ["no_packets", "no_packets", "ok"]
    assert (found[0]["total_bytes"], found[1]["total_bytes"]) == (0, 5)
    assert found[1]["sessions"] is None and found[1]["missing"] is None
    assert (found[2]["flashbacks"], found[2]["event_runs"]) == ("", 0)


def test_event_logs_are_counted_and_listed_in_parts(spark, raw):
    codes = [b"AAAA", b"BBBB"] * 3
    df = raw({1: [datagram(3, size=33, code=c) for c in codes], 2: [datagram()]})
    found = summary_of(spark, df, [1, 2])
    assert (found[1]["event_runs"], found[2]["event_runs"]) == (6, 0)
    assert "events" not in found[1].asDict()
    parts = sequence.event_sequence(sequence.event_runs(decode_headers(df)), 1)
    assert rows(parts.select("capture_id", "part", "sequence"), "part") == [
        (1, k, "AAAA BBBB") for k in range(3)
    ]


def test_clock_starts_at_the_first_valid_packet(spark, raw):
    df = raw({1: [datagram(size=10), datagram(), datagram(size=3), datagram()]}, step=1.0)
    assert rows(stats.capture_uptime(decode_headers(df))) == [(1, 2.0)]
    manifest = spark.createDataFrame([(1, 0)], "capture_id int, anchor_us bigint")
    timed = with_recv_ts(datagrams(df), manifest)
    report = interval_report(timed, decode_headers(timed), 2.0)
    # The clock reads 100 at the runt, 101 at the first packet; windows end at 102, 104.
    assert rows(report.select("uptime", "megabytes", "total", "is_partial"), "uptime") == [
        (1.0, 39 / 1e6, 1, False),
        (3.0, 71 / 1e6, 2, True),
    ]


@pytest.mark.parametrize("block_bits", [0, 1, 12])
def test_silent_types_report_zero(spark, raw, block_bits):
    made = [datagram(0), datagram(2), datagram(2), datagram(2), datagram(0)]
    manifest = spark.createDataFrame([(1, 0)], "capture_id int, anchor_us bigint")
    df = decode_headers(with_recv_ts(raw({1: made}, step=1.0), manifest))
    dense = rates.dense_rates(rates.with_window(df, 1.0), 1.0, block_bits)
    assert rows(
        dense.select("packet_id", "window_index", "n", "total", "hz"), "packet_id", "window_index"
    ) == [
        (0, 100, 1, 1, 1.0),
        (0, 101, 0, 1, 0.0),
        (0, 102, 0, 1, 0.0),
        (0, 103, 0, 1, 0.0),
        (0, 104, 1, 2, 1.0),
        (2, 101, 1, 1, 1.0),
        (2, 102, 1, 2, 1.0),
        (2, 103, 1, 3, 1.0),
        (2, 104, 0, 3, 0.0),
    ]


def test_rate_of_an_empty_interval(spark):
    from wiretally.functions import rate

    assert rows(spark.range(1).select(rate(F.lit(5), F.lit(0.0)))) == [(0.0,)]


def test_catalog(spark):
    catalog = names.packet_types(spark)
    assert catalog.count() == 14
    named = names.with_packet_name(catalog.select("packet_id"))
    assert named.exceptAll(catalog).count() == 0
