"""The final summary, one row per capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.layout import PACKET_NAMES, UNKNOWN_NAME
from wiretally.operators.names import packet_name
from wiretally.operators.ordering import CHUNK_BITS
from wiretally.operators.sequence import event_run_counts
from wiretally.operators.stats import (
    capture_facts_and_sessions,
    capture_totals,
    packet_type_stats,
)


def type_texts(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Missing types and flashbacks of each capture as text, in id order.

    Both come from one pass over the types of a capture, at most 256.
    """
    seen = (
        packet_type_stats(packets, chunk_bits)
        .groupBy("capture_id")
        .agg(F.sort_array(F.collect_list(F.struct("packet_id", "backwards"))).alias("_types"))
    )
    catalog = F.array(*[F.lit(i) for i in PACKET_NAMES])
    absent = F.array_except(catalog, F.col("_types.packet_id"))
    fell_back = F.filter("_types", lambda t: t["backwards"] > 0)
    return seen.select(
        "capture_id",
        F.array_join(
            F.transform(absent, lambda i: packet_name(i, F.lit(UNKNOWN_NAME))), ", "
        ).alias("missing"),
        F.array_join(
            F.transform(
                fell_back,
                lambda t: F.concat_ws(
                    " ",
                    packet_name(t["packet_id"], t["packet_id"].cast("string")),
                    t["backwards"].cast("string"),
                ),
            ),
            ", ",
        ).alias("flashbacks"),
    )


def capture_summary(
    manifest: DataFrame,
    datagrams: DataFrame,
    packets: DataFrame,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """All facts of a capture in one row, for every capture of the manifest.

    ``datagrams`` has ``capture_id, size`` and includes runts. A capture with
    no valid packet has status ``no_packets``: its datagrams and bytes are
    still counted, all else is NULL. Event codes are counted here and listed,
    in rows of bounded size, by ``event_sequence``.
    """

    summary = manifest.select("capture_id")
    for part in (
        capture_totals(datagrams).drop("megabytes"),
        capture_facts_and_sessions(packets).drop("recv_mono"),
        type_texts(packets, chunk_bits),
        event_run_counts(packets, chunk_bits),
    ):
        summary = summary.join(part, "capture_id", "left")

    has_packets = F.col("packets").isNotNull()

    def if_any(column, default):
        return F.when(has_packets, F.coalesce(column, F.lit(default)))

    return summary.withColumns(
        {
            "status": F.when(has_packets, "ok").otherwise("no_packets"),
            "datagrams": F.coalesce("datagrams", F.lit(0)),
            "runts": F.coalesce("runts", F.lit(0)),
            "total_bytes": F.coalesce("total_bytes", F.lit(0)),
            "megabytes": F.coalesce("total_bytes", F.lit(0)) / F.lit(1e6),
            "missing": if_any(F.col("missing"), ""),
            "flashbacks": if_any(F.col("flashbacks"), ""),
            "event_runs": if_any(F.col("event_runs"), 0),
        }
    )


def in_report_order(report: DataFrame) -> DataFrame:
    """Rows by capture and type; for the small reports, one row per capture or type."""
    return report.orderBy(*[c for c in ("capture_id", "packet_id") if c in report.columns])
