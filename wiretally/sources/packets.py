"""Decoded packets in Parquet: decode once, then query columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_packets(packets: DataFrame, path: str, mode: str = "append") -> None:
    """Store decoded packets so that capture and type prune.

    Captures are folders. Within a file rows lie by type, then in arrival
    order, so that row groups hold few types and ``seq`` compresses well.
    """
    ordered = packets.sortWithinPartitions("capture_id", "packet_id", "seq")
    ordered.write.mode(mode).partitionBy("capture_id").parquet(path)


def read_packets_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored packets; filters and columns reach the scan."""
    return spark.read.parquet(path)
