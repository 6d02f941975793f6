"""Windowed rates and sessions over a packet stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions import rate


def stream_packet_rates(
    packets: DataFrame, seconds: float, late_by: str | None = None
) -> DataFrame:
    """Packets and rate per capture, window and type.

    With ``late_by`` a watermark drops state once windows are that old, and
    the result suits ``append`` or ``update``. The watermark is shared by all
    captures of the query, so it fits live data only; replays of older
    captures belong in the batch operator. Without, use ``complete``.
    """
    if late_by:
        packets = packets.withWatermark("recv_ts", late_by)
    window = F.window("recv_ts", f"{round(seconds * 1000)} milliseconds")
    return (
        packets.groupBy("capture_id", window, "packet_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "capture_id",
            F.col("window.start").alias("window_start"),
            "packet_id",
            "n",
            rate(F.col("n"), F.lit(float(seconds))).alias("hz"),
        )
    )


def stream_sessions(packets: DataFrame, late_by: str | None = None) -> DataFrame:
    """Distinct sessions per capture, for ``update`` or ``complete``.

    Duplicates drop by (capture, session), so no task sees a whole capture.
    Without ``late_by`` the count is exact and every session ever seen is kept.
    With it, ``packets`` need ``recv_ts`` and a session is forgotten once its
    first packet is that much older than the newest of the query: state stays
    bounded, and a session that lasts longer than that counts again.
    """
    keys = ["capture_id", "session_uid"]
    if late_by:
        timed = packets.select(*keys, "recv_ts").withWatermark("recv_ts", late_by)
        distinct = timed.dropDuplicatesWithinWatermark(keys)
    else:
        distinct = packets.select(*keys).dropDuplicates(keys)
    return distinct.groupBy("capture_id").agg(F.count(F.lit(1)).alias("sessions"))


def stream_type_stats(packets: DataFrame) -> DataFrame:
    """Count, bytes and sizes per capture and type so far, for ``update`` or ``complete``.

    State is a row per type; a type has at most as many sizes as a datagram.
    """
    return packets.groupBy("capture_id", "packet_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("size").cast("bigint")).alias("bytes"),
        F.sort_array(F.collect_set("size")).alias("sizes"),
    )
