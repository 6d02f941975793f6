"""Streams give the batch answer, in one micro-batch or in many."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F
from wire import log, random_capture

from wiretally.operators import rates, sequence, stats
from wiretally.sources.anchors import with_recv_ts
from wiretally.operators.headers import decode_headers
from wiretally.session import LISTING_TASKS
from wiretally.sources.archive import read_archive, stream_archive, write_archive
from wiretally.sources.captures import read_captures, read_packets
from wiretally.streaming.aggregates import (
    stream_packet_rates,
    stream_sessions,
    stream_type_stats,
)
from wiretally.streaming.ingest import stream_captures, stream_from_archive
from wiretally.streaming.results import run_appending, run_complete
from wiretally.streaming.stateful import stream_event_runs, stream_reversals

SEGMENT = 50


def land(folder, capture, made, first, when):
    target = folder / f"capture_id={capture}"
    target.mkdir(parents=True, exist_ok=True)
    path = target / f"segment-{first:08d}.bin"
    path.write_bytes(log(made[first : first + SEGMENT], start=100.0 + first * 0.25))
    os.utime(path, (when, when))


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    """Two captures in segments of 50 records, written in order."""
    folder = tmp_path_factory.mktemp("landing")
    rng = random.Random(11)
    made = {c: [d for d in random_capture(rng, 330) if d] for c in (1, 2)}
    for i in range(0, max(map(len, made.values())), SEGMENT):
        for c in made:
            if i < len(made[c]):
                land(folder, c, made[c], i, 1_700_000_000 + i)
    return str(folder)


@pytest.fixture(params=[1, 3, 1000], ids=["1-file", "3-files", "all-files"])
def live(spark, landing, request):
    return stream_captures(spark, landing, "int", request.param, headers_only=True)


@pytest.fixture
def batch(spark, landing):
    return read_packets(spark, landing, "int")


def anchors(spark):
    return spark.createDataFrame([(1, 0), (2, 0)], "capture_id int, anchor_us bigint")


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def test_reversals(live, batch, tmp_path):
    found = run_appending(stream_reversals(live), "t", str(tmp_path))
    assert found.where("out_of_order").count() == 0
    same(found.drop("out_of_order"), sequence.reversals(batch))


def test_event_runs(live, batch, tmp_path):
    found = run_appending(stream_event_runs(live), "t", str(tmp_path))
    assert found.where("out_of_order").count() == 0
    same(found.drop("out_of_order"), sequence.event_runs(batch))


def test_sessions(live, batch, tmp_path):
    same(
        run_complete(stream_sessions(live), "t", str(tmp_path)), stats.capture_sessions(batch)
    )


def test_rates(spark, live, batch, tmp_path):
    timed = with_recv_ts(live, anchors(spark))
    found = run_complete(stream_packet_rates(timed, 2.0), "t", str(tmp_path))
    windowed = rates.with_window(with_recv_ts(batch, anchors(spark)), 2.0)
    want = rates.packet_rates(windowed, 2.0).withColumn("window_start", rates.window_start(2.0))
    same(found, want)


def test_rates_with_a_watermark_drop_nothing_in_order(spark, live, batch, tmp_path):
    timed = with_recv_ts(live, anchors(spark))
    found = run_appending(stream_packet_rates(timed, 2.0, "1 hour"), "t", str(tmp_path))
    # Windows above the watermark stay open, so an append run may only lag behind.
    windowed = rates.with_window(with_recv_ts(batch, anchors(spark)), 2.0)
    want = rates.packet_rates(windowed, 2.0).withColumn("window_start", rates.window_start(2.0))
    assert found.exceptAll(want.select(*found.columns)).count() == 0


def test_archive(spark, landing, tmp_path):
    raw = stream_captures(spark, landing, "int", 3)
    out, checkpoint = str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        stream_archive(raw, out, checkpoint).awaitTermination()
    kept = ["capture_id", "seq", "recv_mono", "size", "payload"]
    same(read_archive(spark, out).select(*kept), read_captures(spark, landing, "int"))


def test_packets_without_segment_order(spark, landing, batch, tmp_path):
    archive = str(tmp_path / "archive")
    raw = read_captures(spark, landing, "int")
    write_archive(raw.orderBy(F.rand(1)), archive)
    live = decode_headers(stream_from_archive(spark, archive))
    found = run_appending(stream_reversals(live, in_order=False), "t", str(tmp_path / "rev"))
    same(found.drop("out_of_order"), sequence.reversals(batch))
    found = run_appending(stream_event_runs(live, in_order=False), "t", str(tmp_path / "runs"))
    same(found.drop("out_of_order"), sequence.event_runs(batch))


def test_disorder_is_an_error_when_order_was_promised(spark, landing, tmp_path):
    archive = str(tmp_path / "archive")
    raw = read_captures(spark, landing, "int")
    odd = F.col("seq") % 2 == 1
    for part in (raw.where(odd), raw.where(~odd)):
        write_archive(part, archive)
    live = decode_headers(stream_from_archive(spark, archive))
    with pytest.raises(Exception, match="must arrive in order"):
        run_appending(stream_reversals(live), "t", str(tmp_path / "rev"))


def test_quiet_captures_lose_their_state(spark, landing, batch, tmp_path):
    live = stream_captures(spark, landing, "int", headers_only=True)
    query = (
        stream_reversals(live, ttl_ms=3_600_000)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "rows"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="1 second")
        .start()
    )
    deadline = time.time() + 60
    while time.time() < deadline and not any(p["batchId"] for p in query.recentProgress):
        time.sleep(0.5)
    query.stop()
    found = spark.read.parquet(str(tmp_path / "rows"))
    same(found.drop("out_of_order"), sequence.reversals(batch))


def test_a_restarted_stream_continues(spark, tmp_path):
    rng = random.Random(3)
    made = [d for d in random_capture(rng, 300) if d]
    folder, work = tmp_path / "landing", tmp_path / "work"
    for first in (0, SEGMENT, 2 * SEGMENT):
        land(folder, 1, made, first, 1_700_000_000 + first)
        live = stream_captures(spark, str(folder), "int", headers_only=True)
        for name, op in (("rev", stream_reversals), ("runs", stream_event_runs)):
            run_appending(op(live), "t", str(work / name))
    batch = read_packets(spark, str(folder), "int")
    same(
        spark.read.parquet(str(work / "rev" / "rows")).drop("out_of_order"),
        sequence.reversals(batch),
    )
    same(
        spark.read.parquet(str(work / "runs" / "rows")).drop("out_of_order"),
        sequence.event_runs(batch),
    )


def test_a_late_segment_is_flagged(spark, tmp_path):
    rng = random.Random(4)
    made = [d for d in random_capture(rng, 300) if d]
    folder, work = tmp_path / "landing", tmp_path / "work"
    for first in (0, 2 * SEGMENT, SEGMENT):
        land(folder, 1, made, first, 1_700_000_000 + first)
        live = stream_captures(spark, str(folder), "int", headers_only=True)
        found = run_appending(stream_reversals(live), "t", str(work))
    flagged = found.where("out_of_order")
    batch = read_packets(spark, str(folder), "int").where(F.col("segment") == SEGMENT)
    heads = batch.groupBy("capture_id", "packet_id").agg(F.min("seq").alias("seq"))
    same(flagged.select("capture_id", "packet_id", "seq"), heads)


def test_type_stats(live, batch, tmp_path):
    found = run_complete(stream_type_stats(live), "t", str(tmp_path))
    same(found.select("capture_id", "packet_id", "n", "sizes"), stats.packet_type_stats(batch))
    totals = batch.groupBy("capture_id", "packet_id").agg(F.sum(F.col("size").cast("long")).alias("bytes"))
    same(found.select("capture_id", "packet_id", "bytes"), totals)


def test_a_restart_without_new_data_finds_the_last_result(spark, landing, tmp_path):
    run = lambda: run_complete(
        stream_sessions(stream_captures(spark, landing, "int", 3, headers_only=True)), "t", str(tmp_path)
    ).collect()
    first = run()
    assert len(first) == 2 and sorted(run()) == sorted(first)
    assert len([p for p in os.listdir(tmp_path) if p.startswith("batch=")]) == 1


def test_sessions_with_expiry_agree_while_captures_are_short(spark, live, batch, tmp_path):
    timed = with_recv_ts(live, anchors(spark))
    found = run_complete(stream_sessions(timed, "1 hour"), "t", str(tmp_path))
    same(found, stats.capture_sessions(batch))


def test_files_of_a_batch_are_not_listed_by_a_task_each(spark, tmp_path):
    made = [d for d in random_capture(random.Random(5), 40 * SEGMENT + 200) if d]
    for first in range(0, 40 * SEGMENT, SEGMENT):
        land(tmp_path / "landing", 1, made, first, 1_700_000_000 + first)
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get(LISTING_TASKS)

    def newest_stage() -> int:
        spark.sparkContext.setJobGroup("mark", "mark")
        spark.sparkContext.parallelize([1], 1).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return max(tracker.getJobInfo(max(tracker.getJobIdsForGroup("mark"))).stageIds)

    first = newest_stage()
    live = stream_captures(spark, str(tmp_path / "landing"), "int", headers_only=True)
    found = run_appending(stream_reversals(live), "t", str(tmp_path / "rev"))
    stages = [tracker.getStageInfo(k) for k in range(first + 1, newest_stage())]
    assert max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism < 40
    assert spark.conf.get(LISTING_TASKS) == before
    same(found.drop("out_of_order"), sequence.reversals(read_packets(spark, str(tmp_path / "landing"), "int")))


def test_stateful_streams_ask_for_their_state_store(spark, landing):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        live = stream_captures(spark, landing, "int", headers_only=True)
        with pytest.raises(ValueError, match="stateStore"):
            stream_reversals(live)
    finally:
        spark.conf.set(key, before)
