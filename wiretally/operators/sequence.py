"""Frame reversals and the run-collapsed event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import event_code_key, is_event
from wiretally.operators.ordering import CHUNK_BITS, with_previous


def with_reversal(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Add ``prev_frame_id`` and ``is_reversal``.

    A packet is a reversal when its frame is strictly lower than that of the
    previous packet of the same type in the same capture, in arrival order.
    Sessions do not matter: a restart in a new session counts too.
    """
    return with_previous(
        packets,
        ["capture_id", "packet_id"],
        "frame_id",
        "prev_frame_id",
        chunk_bits=chunk_bits,
    ).withColumn(
        "is_reversal",
        F.coalesce(F.col("frame_id") < F.col("prev_frame_id"), F.lit(False)),
    )


def reversals(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Only the reversal packets, with the frame they fell back from."""
    narrow = packets.select("capture_id", "packet_id", "seq", "frame_id")
    return with_reversal(narrow, chunk_bits).where("is_reversal").drop("is_reversal")


def event_packets(packets: DataFrame, *more: str) -> DataFrame:
    """Event packets that hold a whole code."""
    return packets.where(is_event(F.col("packet_id"), F.col("size"))).select(
        "capture_id", "seq", F.col("event_code").alias("code"), "session_time", *more
    )


def event_runs(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The first packet of every run of equal event codes in a capture.

    Codes compare with the previous event of the capture, across sessions.
    Equal neighbours carry the same code as the last one kept, so comparing
    with the previous event is exact.
    """
    events = event_packets(packets).withColumn("_key", event_code_key(F.col("code")))
    return (
        with_previous(events, ["capture_id"], "_key", "_prev", chunk_bits=chunk_bits)
        .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("_key")))
        .drop("_key", "_prev")
    )


def event_run_counts(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Event runs per capture, without listing them.

    Chunks of the arrival order fold to the changes inside and to their first
    and last code; a run also begins where a chunk starts with another code
    than the one before ended on.
    """
    chunk_keys = ["capture_id", "_chunk"]
    inside = Window.partitionBy(*chunk_keys).orderBy("seq")
    events = event_packets(packets).select(
        "capture_id",
        "seq",
        event_code_key(F.col("code")).alias("_key"),
        F.shiftright("seq", chunk_bits).alias("_chunk"),
    )
    chunks = (
        events.withColumn("_change", F.col("_key") != F.lag("_key").over(inside))
        .groupBy(*chunk_keys)
        .agg(
            F.count_if("_change").alias("_changes"),
            F.min_by("_key", "seq").alias("_first"),
            F.max_by("_key", "seq").alias("_last"),
        )
    )
    order = Window.partitionBy("capture_id").orderBy("_chunk")
    begins = F.coalesce((F.col("_first") != F.lag("_last").over(order)).cast("bigint"), F.lit(1))
    linked = chunks.withColumn("_begins", begins)
    return linked.groupBy("capture_id").agg(
        F.sum(F.col("_changes") + F.col("_begins")).alias("event_runs")
    )


def event_sequence(runs: DataFrame, part_bits: int = CHUNK_BITS) -> DataFrame:
    """The codes of a capture in order, joined by a space, in parts.

    A part covers ``2**part_bits`` consecutive ``seq`` values, so no row grows
    with the capture. Captures shorter than that have the single part 0; the
    parts of a longer one, joined by a space in ``part`` order, are the whole.
    """
    return (
        runs.groupBy("capture_id", F.shiftright("seq", part_bits).alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n_codes"),
            F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("_codes"),
        )
        .select(
            "capture_id",
            "part",
            "n_codes",
            F.array_join(F.col("_codes.code"), " ").alias("sequence"),
        )
    )
