"""Wall-clock times for captures stamped with a monotonic clock.

Monotonic times compare only within one capture. An anchor is the wall-clock
time, in microseconds since the epoch, at which a capture's clock read zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.operators.lookup import BROADCAST_CAPTURES, join_per_capture


def with_recv_ts(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``recv_ts``; NULL for captures the manifest does not anchor.

    The manifest (``capture_id, anchor_us``) has a row per capture. It is
    counted: a small one is broadcast, with a larger one rows shuffle by capture
    and salt.
    """
    anchors = manifest.select("capture_id", "anchor_us")
    captures = anchors.limit(BROADCAST_CAPTURES + 1).count()
    micros = F.col("anchor_us") + F.round(F.col("recv_mono") * F.lit(1e6)).cast("bigint")
    return (
        join_per_capture(df, anchors, "left", captures)
        .withColumn("recv_ts", F.timestamp_micros(micros))
        .drop("anchor_us")
    )


def unanchored_captures(stamped: DataFrame) -> DataFrame:
    """Captures without a wall clock, and their rows, for batch or a stream.

    Windows from the epoch leave them out; windows relative to the first packet
    do not.
    """
    lost = stamped.where("recv_ts IS NULL").groupBy("capture_id")
    return lost.agg(F.count(F.lit(1)).alias("n"))


def approximate_anchors(packets_raw: DataFrame, files: DataFrame) -> DataFrame:
    """Anchors for captures without a manifest, flagged ``approximate``.

    Takes a capture's last record as received when its last file was written.
    """
    last_record = packets_raw.groupBy("capture_id").agg(F.max("recv_mono").alias("_last"))
    last_write = files.groupBy("capture_id").agg(F.max("modified_at").alias("_written"))
    return last_record.join(last_write, "capture_id").select(
        "capture_id",
        (F.unix_micros("_written") - F.round(F.col("_last") * F.lit(1e6)).cast("bigint")).alias(
            "anchor_us"
        ),
        F.lit(True).alias("approximate"),
    )
