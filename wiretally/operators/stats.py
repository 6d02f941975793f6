"""Aggregates per packet type and per capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import is_expected_format, is_valid, megabytes
from wiretally.operators.ordering import CHUNK_BITS

TYPE_KEYS = ["capture_id", "packet_id"]


def packet_counts(packets: DataFrame) -> DataFrame:
    """Packets per capture and type."""
    return packets.groupBy(*TYPE_KEYS).agg(F.count(F.lit(1)).alias("n"))


def packet_sizes(packets: DataFrame) -> DataFrame:
    """Distinct sizes per capture and type, ascending.

    Duplicates go in a hash aggregate before the arrays are built; what is
    collected is at most one entry per possible datagram size.
    """
    return (
        packets.select(*TYPE_KEYS, "size")
        .distinct()
        .groupBy(*TYPE_KEYS)
        .agg(F.sort_array(F.collect_list("size")).alias("sizes"))
    )


def last_frames(packets: DataFrame) -> DataFrame:
    """Frame of the last packet per capture and type, in arrival order."""
    return packets.groupBy(*TYPE_KEYS).agg(F.max_by("frame_id", "seq").alias("last_frame"))


def chunk_profiles(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Mergeable type statistics per chunk of the arrival order.

    One shuffle by (capture, type, chunk) serves the window and both
    aggregates. Rows first fold per size, where all buffers are plain numbers
    and the aggregate stays hash-based; sizes become an array only then.
    """
    chunk_keys = [*TYPE_KEYS, "_chunk"]
    inside = Window.partitionBy(*chunk_keys).orderBy("seq")
    by_size = (
        packets.select(
            *TYPE_KEYS, "seq", "size", "frame_id", F.shiftright("seq", chunk_bits).alias("_chunk")
        )
        .withColumn("_back", F.col("frame_id") < F.lag("frame_id").over(inside))
        .groupBy(*chunk_keys, "size")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_back").alias("backwards"),
            F.min("seq").alias("_first_seq"),
            F.max("seq").alias("_last_seq"),
            F.min_by("frame_id", "seq").alias("_first_frame"),
            F.max_by("frame_id", "seq").alias("_last_frame"),
        )
    )
    return by_size.groupBy(*chunk_keys).agg(
        F.sum("n").alias("n"),
        F.sum("backwards").alias("backwards"),
        F.min_by("_first_frame", "_first_seq").alias("first_frame"),
        F.max_by("_last_frame", "_last_seq").alias("last_frame"),
        F.collect_list("size").alias("sizes"),
    )


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Fold chunk profiles, in chunk order, into one row per capture and type.

    A boundary adds a reversal when a chunk starts below the frame its
    predecessor ended on. Sizes stream through one bounded set: the first size
    of a chunk carries the chunk's numbers, the others carry none.
    """
    order = Window.partitionBy(*TYPE_KEYS).orderBy("_chunk")
    at_boundary = F.coalesce(
        (F.col("first_frame") < F.lag("last_frame").over(order)).cast("bigint"), F.lit(0)
    )
    opened = profiles.select(
        *TYPE_KEYS,
        "_chunk",
        "n",
        "last_frame",
        (F.col("backwards") + at_boundary).alias("backwards"),
        F.col("sizes"),
    ).select("*", F.posexplode("sizes").alias("_pos", "_size"))
    once = F.col("_pos") == 0
    return opened.groupBy(*TYPE_KEYS).agg(
        F.sum(F.when(once, F.col("n"))).alias("n"),
        F.sort_array(F.collect_set("_size")).alias("sizes"),
        F.sum(F.when(once, F.col("backwards"))).alias("backwards"),
        F.max_by("last_frame", "_chunk").alias("last_frame"),
    )


def packet_type_stats(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Count, sizes, reversals and last frame per capture and type."""
    return merge_profiles(chunk_profiles(packets, chunk_bits))


def reversal_counts(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Reversals per capture and type.

    Chunks fold to their number of reversals and their first and last frame;
    sizes take no part.
    """
    chunk_keys = [*TYPE_KEYS, "_chunk"]
    inside = Window.partitionBy(*chunk_keys).orderBy("seq")
    chunks = (
        packets.select(*TYPE_KEYS, "seq", "frame_id", F.shiftright("seq", chunk_bits).alias("_chunk"))
        .withColumn("_back", F.col("frame_id") < F.lag("frame_id").over(inside))
        .groupBy(*chunk_keys)
        .agg(
            F.count_if("_back").alias("backwards"),
            F.min_by("frame_id", "seq").alias("first_frame"),
            F.max_by("frame_id", "seq").alias("last_frame"),
        )
    )
    order = Window.partitionBy(*TYPE_KEYS).orderBy("_chunk")
    falls = (F.col("first_frame") < F.lag("last_frame").over(order)).cast("bigint")
    linked = chunks.withColumn("_falls", F.coalesce(falls, F.lit(0)))
    return linked.groupBy(*TYPE_KEYS).agg(F.sum(F.col("backwards") + F.col("_falls")).alias("backwards"))


def capture_totals(datagrams: DataFrame) -> DataFrame:
    """Datagrams, runts and payload bytes per capture; runts count as bytes."""
    return (
        datagrams.groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("datagrams"),
            F.count_if(~is_valid(F.col("size"))).alias("runts"),
            F.sum(F.col("size").cast("bigint")).alias("total_bytes"),
        )
        .withColumn("megabytes", megabytes(F.col("total_bytes")))
    )


def capture_uptime(packets: DataFrame) -> DataFrame:
    """Seconds from the first to the last valid packet, per capture."""
    return capture_facts(packets).select("capture_id", "uptime")


def capture_sessions(packets: DataFrame) -> DataFrame:
    """Distinct sessions per capture, exact."""
    return packets.groupBy("capture_id").agg(
        F.count_distinct("session_uid").alias("sessions")
    )


FIRST_FACTS = ["packet_format", "game_year", "game_major", "game_minor", "player_car"]


def first_packet(packets: DataFrame) -> DataFrame:
    """Facts of the first valid packet of each capture."""
    return capture_facts(packets).select(
        "capture_id", "seq", *FIRST_FACTS, "recv_mono", "format_ok"
    )


def capture_facts(packets: DataFrame) -> DataFrame:
    """First-packet facts, packet count and uptime of each capture in one pass.

    ``seq`` is unique in a capture, so every ``min_by`` picks the same packet.
    One ``min_by`` per number keeps the aggregate hash-based; a struct would
    make Spark sort its whole input.
    """
    return (
        packets.groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("packets"),
            (F.max("recv_mono") - F.min("recv_mono")).alias("uptime"),
            F.min("seq").alias("seq"),
            *[F.min_by(f, "seq").alias(f) for f in (*FIRST_FACTS, "recv_mono")],
        )
        .withColumn("format_ok", is_expected_format(F.col("packet_format")))
    )


def capture_facts_and_sessions(packets: DataFrame) -> DataFrame:
    """``capture_facts`` with ``sessions``, from one pass over the packets.

    Packets first fold per session, so that distinct sessions are counted
    without a second pass.
    """
    earliest = (*FIRST_FACTS, "recv_mono")
    by_session = packets.groupBy("capture_id", "session_uid").agg(
        F.count(F.lit(1)).alias("packets"),
        F.max("recv_mono").alias("_last"),
        F.min("recv_mono").alias("_first"),
        F.min("seq").alias("seq"),
        *[F.min_by(f, "seq").alias(f) for f in earliest],
    )
    return (
        by_session.groupBy("capture_id")
        .agg(
            F.sum("packets").alias("packets"),
            F.count("session_uid").alias("sessions"),
            (F.max("_last") - F.min("_first")).alias("uptime"),
            *[F.min_by(f, "seq").alias(f) for f in earliest],
        )
        .withColumn("format_ok", is_expected_format(F.col("packet_format")))
    )
