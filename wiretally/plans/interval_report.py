"""The report a live probe prints at every interval, for all intervals at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions import is_datagram, is_valid, megabytes, rate, size_text
from wiretally.operators.names import with_packet_name
from wiretally.operators.ordering import BLOCK_BITS, dense_running_sums
from wiretally.operators.rates import (
    TYPE_KEYS,
    capture_starts,
    new_sessions,
    packet_rates,
    window_start,
    with_relative_window,
    with_window,
)

# Stands for the capture as a whole beside its types; ids on the wire are 0..255.
WHOLE_CAPTURE = -1
VALUES = ["n", "bytes", "sessions"]


def interval_report(
    datagrams: DataFrame,
    packets: DataFrame,
    seconds: float = 2.0,
    block_bits: int = BLOCK_BITS,
    relative: bool = False,
) -> DataFrame:
    """Per capture, window and type seen so far: totals since start and rate.

    ``datagrams`` has ``capture_id, seq, recv_ts, size`` and includes runts,
    whose bytes count; ``packets`` are the valid ones. Reports run from the
    window of the first valid packet to that of the last datagram. ``uptime``
    is the time from the first valid packet to the end of the window.

    Windows count from the epoch, which needs ``recv_ts``; captures without a
    clock anchor are then left out, and ``unanchored_captures`` lists them. With
    ``relative`` they count from the capture's first valid packet by its own
    clock, ``recv_mono``, so that every capture is reported.

    Types and the capture as a whole go through one dense running sum, as rows
    of the same keys. The capture's numbers then reach its types by a window
    over the at most 257 rows of one capture and window.
    """
    d = datagrams.where(is_datagram(F.col("size")))
    p = packets.where(is_valid(F.col("size")))
    ends = F.col("window_index") + 1
    if relative:
        starts = capture_starts(p)
        d, p = (with_relative_window(t, seconds, starts) for t in (d, p))
        started, uptime = F.lit(0), ends * F.lit(float(seconds))
    else:
        d, p = with_window(d, seconds), with_window(p, seconds)
        width = F.lit(round(seconds * 1_000_000))
        started, uptime = F.unix_micros("recv_ts"), (ends * width - F.col("_started")) / F.lit(1e6)
    seen = F.filter("_steps", lambda s: s["first"] <= F.col("window_index"))
    dense = dense_running_sums(
        _spans(d, p, started),
        _deltas(d, p, seconds),
        TYPE_KEYS,
        "window_index",
        VALUES,
        {
            "sizes": size_text(F.transform(seen, lambda s: s["size"])),
            "uptime": uptime,
            "is_partial": F.col("window_index") == F.col("hi"),
        },
        block_bits,
    )
    window = Window.partitionBy("capture_id", "window_index")

    def of_capture(value: str):
        whole = F.when(F.col("packet_id") == WHOLE_CAPTURE, F.col(value))
        return F.max(whole).over(window)

    rows = dense.select(
        "capture_id",
        "window_index",
        *([] if relative else [window_start(seconds).alias("window_start")]),
        "is_partial",
        "uptime",
        megabytes(of_capture("bytes_total")).alias("megabytes"),
        of_capture("sessions_total").alias("sessions"),
        "packet_id",
        F.col("n_total").alias("total"),
        rate(F.col("n"), F.lit(float(seconds))).alias("hz"),
        "sizes",
    )
    return with_packet_name(rows.where(F.col("packet_id") != WHOLE_CAPTURE))


def _spans(d: DataFrame, p: DataFrame, started: Column) -> DataFrame:
    """First and last window of every type and of the capture as a whole.

    A type's sizes, each with its first window, fit one row: a datagram has at
    most 4096 sizes. That row also opens the windows, so no join is needed to
    know which sizes had been seen by each of them.
    """
    first_by_size = p.groupBy(*TYPE_KEYS, "size").agg(F.min("window_index").alias("first"))
    step = F.when(F.col("packet_id") != WHOLE_CAPTURE, F.struct("size", "first"))
    firsts = (
        first_by_size.withColumn(
            "packet_id", F.explode(F.array("packet_id", F.lit(WHOLE_CAPTURE)))
        )
        .groupBy(*TYPE_KEYS)
        .agg(F.min("first").alias("lo"), F.collect_list(step).alias("_steps"))
    )
    valid_seq = F.when(is_valid(F.col("size")), F.col("seq"))
    bounds = d.groupBy("capture_id").agg(
        F.max("window_index").alias("hi"),
        F.min_by(started, valid_seq).alias("_started"),
    )
    return firsts.join(bounds, "capture_id")


def _deltas(d: DataFrame, p: DataFrame, seconds: float) -> DataFrame:
    """What each window adds to a type and to the capture as a whole."""
    whole = F.lit(WHOLE_CAPTURE).alias("packet_id")
    received = d.groupBy("capture_id", "window_index").agg(
        F.sum(F.col("size").cast("bigint")).alias("bytes")
    )
    parts = [
        (packet_rates(p, seconds).select(*TYPE_KEYS, "window_index", "n"), "n"),
        (received.select("capture_id", whole, "window_index", "bytes"), "bytes"),
        (
            new_sessions(p)
            .groupBy("capture_id", "window_index")
            .agg(F.count(F.lit(1)).alias("sessions"))
            .select("capture_id", whole, "window_index", "sessions"),
            "sessions",
        ),
    ]

    def padded(part: DataFrame, value: str) -> DataFrame:
        return part.select(
            *TYPE_KEYS,
            "window_index",
            *[(F.col(v) if v == value else F.lit(0)).cast("bigint").alias(v) for v in VALUES],
        )

    first, *others = [padded(*part) for part in parts]
    for other in others:
        first = first.unionByName(other)
    return first
