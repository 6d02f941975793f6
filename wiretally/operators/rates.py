"""Packet counts and rates per tumbling window.

Windows are fixed and half-open, ``[start, end)``, and a rate divides by the
window's full width. A live probe that closes a window at the first packet
after its interval has irregular edges that no capture records, so totals and
counts per type agree with such a probe while single rates can differ at the
edges. The last window of a capture is kept and marked ``is_partial``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import is_valid, rate
from wiretally.operators.lookup import BROADCAST_CAPTURES, join_per_capture
from wiretally.operators.ordering import BLOCK_BITS, dense_running_sums, running_sums
from wiretally.session import stored

TYPE_KEYS = ["capture_id", "packet_id"]


def with_window(df: DataFrame, seconds: float) -> DataFrame:
    """Add ``window_index``, counted in windows of ``seconds`` from the epoch."""
    width = F.lit(_micros(seconds))
    micros = F.unix_micros("recv_ts")
    start = micros - F.pmod(micros, width)
    return df.withColumn("window_index", (start / width).cast("bigint"))


def capture_starts(packets: DataFrame) -> DataFrame:
    """``(capture_id, started)``: each capture's own clock at its first packet.

    Worked out when this is called and kept below ``spark.checkpoint.dir``, so
    that it can be counted and used more than once for one read of the packets.
    """
    starts = packets.groupBy("capture_id").agg(F.min_by("recv_mono", "seq").alias("started"))
    return stored(starts, "capture-starts")


def with_relative_window(
    df: DataFrame, seconds: float, starts: DataFrame | None = None
) -> DataFrame:
    """Add ``window_index``, counted from each capture's first valid packet.

    Needs no clock anchor: both times come from the capture's own clock.
    ``starts`` is from ``capture_starts``, by default of ``df`` itself; rows of
    ``df`` before it have negative windows, captures without one have no rows.
    The starts are counted: few are broadcast, with more of them rows shuffle by
    capture and salt.
    """
    starts = capture_starts(df) if starts is None else starts
    captures = starts.limit(BROADCAST_CAPTURES + 1).count()
    started = starts.select("capture_id", F.col("started").alias("_started"))
    return (
        join_per_capture(df, started, "inner", captures)
        .withColumn(
            "window_index",
            F.floor((F.col("recv_mono") - F.col("_started")) / F.lit(float(seconds))),
        )
        .drop("_started")
    )


def window_start(seconds: float) -> Column:
    """Start of the window with this ``window_index``."""
    return F.timestamp_micros(F.col("window_index") * F.lit(_micros(seconds)))


def _micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def packet_rates(windowed: DataFrame, seconds: float) -> DataFrame:
    """Packets and rate per capture, window and type that occurs in it.

    A capture without a clock anchor has one row per type, its window and rate
    NULL; relative windows give it rates.
    """
    in_window = F.col("window_index").isNotNull()
    return (
        windowed.groupBy(*TYPE_KEYS, "window_index")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("hz", F.when(in_window, rate(F.col("n"), F.lit(float(seconds)))))
    )


def type_spans(windowed: DataFrame) -> DataFrame:
    """Per capture and type: ``lo``, its first window, and ``hi``, the capture's last.

    The window runs over at most 256 rows per capture, one per type.
    """
    bounds = windowed.groupBy(*TYPE_KEYS).agg(
        F.min("window_index").alias("lo"), F.max("window_index").alias("_last")
    )
    return bounds.select(
        *TYPE_KEYS, "lo", F.max("_last").over(Window.partitionBy("capture_id")).alias("hi")
    )


def dense_rates(windowed: DataFrame, seconds: float, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``packet_rates`` zero-filled: a row for every type seen so far in every window.

    Also adds ``total``, the packets of the type since the capture began.
    """
    return (
        dense_running_sums(
            type_spans(windowed),
            packet_rates(windowed, seconds),
            TYPE_KEYS,
            "window_index",
            ["n"],
            block_bits=block_bits,
        )
        .withColumnRenamed("n_total", "total")
        .withColumn("hz", rate(F.col("n"), F.lit(float(seconds))))
    )


def running_type_totals(rates: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``total``: packets of the type up to and including each window."""
    return running_sums(
        rates, TYPE_KEYS, "window_index", ["n"], block_bits
    ).withColumnRenamed("n_total", "total")


def new_sessions(packets: DataFrame) -> DataFrame:
    """The window each session of a capture first occurs in."""
    return packets.groupBy("capture_id", "session_uid").agg(
        F.min("window_index").alias("window_index")
    )


def running_capture_totals(
    datagrams: DataFrame, packets: DataFrame, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Bytes, packets and sessions since the capture began, per window with data.

    A session counts in its first window, so the running sum of the new ones
    is the number of distinct sessions so far.
    """
    zero = F.lit(0).cast("bigint")
    received = datagrams.groupBy("capture_id", "window_index").agg(
        F.sum(F.col("size").cast("bigint")).alias("bytes"),
        F.count_if(is_valid(F.col("size"))).alias("packets"),
    )
    deltas = (
        received.withColumn("sessions", zero)
        .unionByName(
            new_sessions(packets).select(
                "capture_id",
                "window_index",
                zero.alias("bytes"),
                zero.alias("packets"),
                F.lit(1).cast("bigint").alias("sessions"),
            )
        )
        .groupBy("capture_id", "window_index")
        .agg(*[F.sum(v).alias(v) for v in ("bytes", "packets", "sessions")])
    )
    return running_sums(
        deltas, ["capture_id"], "window_index", ["bytes", "packets", "sessions"], block_bits
    )
