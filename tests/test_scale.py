"""Hot captures stay spread, and scans read only what a query needs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wiretally.operators import sequence, stats
from wiretally.operators.lookup import join_per_capture
from wiretally.operators.rates import capture_starts, with_relative_window
from wiretally.plans.capture_summary import capture_summary
from wiretally.plans.interval_report import interval_report


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    """Half of all packets in one capture, frames that restart, few sizes."""
    path = str(tmp_path_factory.mktemp("packets") / "packets")
    (
        spark.range(0, 100_000, 1, 4)
        .selectExpr(
            "cast(if(id % 2 = 0, 0, id % 32) AS int) AS capture_id",
            "id AS seq",
            "cast(29 + pmod(hash(id), 3) * 400 AS int) AS size",
            "cast(pmod(hash(id, 1), 5) AS int) AS packet_id",
            "cast(pmod(id, 9000) + pmod(hash(id, 2), 40) AS bigint) AS frame_id",
            "cast(id AS float) AS session_time",
            "element_at(array('AAAA', 'BBBB'), 1 + pmod(hash(id, 3), 2)) AS event_code",
        )
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk_bits", [6, 10, 20])
def test_hot_capture_equals_plain_lag(packets, chunk_bits):
    order = Window.partitionBy("capture_id", "packet_id").orderBy("seq")
    plain = (
        packets.withColumn("prev_frame_id", F.lag("frame_id").over(order))
        .where("frame_id < prev_frame_id")
        .select("capture_id", "packet_id", "seq", "frame_id", "prev_frame_id")
    )
    found = sequence.reversals(packets, chunk_bits).select(*plain.columns)
    assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0
    counts = plain.groupBy("capture_id", "packet_id").agg(F.count("seq").alias("backwards"))
    merged = stats.reversal_counts(packets, chunk_bits).where("backwards > 0")
    assert merged.exceptAll(counts).count() == 0 and counts.exceptAll(merged).count() == 0


@pytest.mark.parametrize("chunk_bits", [6, 20])
def test_hot_capture_event_runs(packets, chunk_bits):
    order = Window.partitionBy("capture_id").orderBy("seq")
    plain = (
        packets.where("packet_id = 3 AND size >= 33")
        .withColumn("prev", F.lag("event_code").over(order))
        .where("prev IS NULL OR prev <> event_code")
        .select("capture_id", "seq", F.col("event_code").alias("code"), "session_time")
    )
    found = sequence.event_runs(packets, chunk_bits)
    assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0


def test_packets_shuffle_by_chunk_and_once(packets):
    plan = plan_of(stats.packet_type_stats(packets))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(shuffles) == 2
    # The packets move by chunk; what moves by (capture, type) is one row per chunk.
    assert "_chunk" in shuffles[-1] and "_chunk" not in shuffles[0]
    assert plan.count("FileScan") == 1


def test_scans_are_pruned(packets):
    def read_columns(df):
        return set(re.search(r"ReadSchema: struct<([^>]*)>", plan_of(df)).group(1).split(","))

    names = {c.split(":")[0] for c in read_columns(stats.packet_type_stats(packets))}
    assert names == {"capture_id", "seq", "size", "packet_id", "frame_id"}
    names = {c.split(":")[0] for c in read_columns(stats.packet_counts(packets))}
    assert names == {"capture_id", "packet_id"}


def test_event_filter_reaches_the_scan(packets):
    plan = plan_of(sequence.event_packets(packets))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "EqualTo(packet_id,3)" in pushed and "GreaterThanOrEqual(size,33)" in pushed


def test_aggregates_stay_hash_based(packets):
    for df in (
        stats.packet_type_stats(packets),
        stats.last_frames(packets),
        sequence.event_runs(packets),
    ):
        assert "SortAggregate" not in plan_of(df)


def test_summary_scans_each_table_a_few_times_at_most(packets):
    full = packets.selectExpr(
        "*",
        "cast(seq AS double) AS recv_mono",
        "cast(seq % 7 AS decimal(20, 0)) AS session_uid",
        *[f"2023 AS {f}" for f in ("packet_format", "game_year", "game_major", "game_minor", "player_car")],
    )
    manifest = full.sparkSession.createDataFrame([(0,), (1,)], "capture_id int")
    found = capture_summary(manifest, full, full, 8)
    assert plan_of(found).count("FileScan") <= 4
    rows = {r["capture_id"]: r for r in found.collect()}
    runs = sequence.event_runs(full, 8).groupBy("capture_id").count().collect()
    assert {r[0]: r[1] for r in runs if r[0] in rows} == {c: r["event_runs"] for c, r in rows.items()}
    assert all(r["sessions"] == 7 for r in rows.values())


def test_no_join_needs_a_broadcast(packets):
    spark = packets.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = stats.reversal_counts(packets, 10)
        plan = plan_of(counts)
        assert "BroadcastExchange" not in plan and "sizes" not in plan and plan.count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_capture_is_spread_when_facts_are_not_broadcast(packets):
    spark = packets.sparkSession
    facts = spark.range(32).selectExpr("cast(id AS int) AS capture_id", "id * 10 AS fact")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = join_per_capture(packets, facts)
        assert re.search(r"Exchange hashpartitioning\(capture_id#\d+, _salt#\d+", plan_of(salted))
        sent = join_per_capture(packets, facts, captures=32)
        assert "BroadcastHashJoin" in plan_of(sent)
        assert salted.exceptAll(sent).count() == 0 and salted.count() == packets.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_relative_windows_move_no_row_when_captures_are_few(packets):
    spark = packets.sparkSession
    timed = packets.selectExpr("*", "seq / 50D AS recv_mono", "seq % 5 AS session_uid")
    starts = capture_starts(timed)
    windowed = with_relative_window(timed, 2.0, starts)
    plan = plan_of(windowed)
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    report = interval_report(timed, timed, relative=True)
    assert "_salt" not in plan_of(report)
    first = {r[0]: r[1] for r in timed.groupBy("capture_id").agg(F.min("recv_mono")).collect()}
    for r in windowed.limit(500).collect():
        assert r["window_index"] == (r["recv_mono"] - first[r["capture_id"]]) // 2.0
    none = spark.createDataFrame([], starts.schema)
    assert with_relative_window(timed, 2.0, none).isEmpty()
