"""The raw archive: every non-empty datagram as received, in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wiretally.operators.headers import datagrams
from wiretally.operators.ordering import CHUNK_BITS


def write_archive(
    packets_raw: DataFrame,
    path: str,
    mode: str = "append",
    cluster: bool = False,
    chunk_bits: int = CHUNK_BITS,
) -> None:
    """Archive datagrams before any validation, runts included.

    Rows that report damage hold no datagram and are not archived; ``damage_in``
    and ``capture_damage`` keep them.

    Rows from capture logs already lie together by capture, so by default
    nothing moves. ``cluster`` first rebalances scattered rows by capture and
    chunk of the arrival order: files come out few and of even size, since
    Spark merges small partitions and splits large ones.
    """
    kept = datagrams(packets_raw)
    if cluster:
        kept = (
            kept.withColumn("_chunk", F.shiftright("seq", chunk_bits))
            .hint("rebalance", "capture_id", "_chunk")
            .drop("_chunk")
        )
    # The writer sorts by capture in any case; with seq, files keep arrival order.
    kept = kept.sortWithinPartitions("capture_id", "seq")
    kept.write.mode(mode).partitionBy("capture_id").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive; queries that need only sizes never read payloads."""
    return spark.read.parquet(path)


def stream_archive(packets_raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Archive a stream exactly once; runs until all files present are taken."""
    return (
        datagrams(packets_raw)
        .writeStream.format("parquet")
        .partitionBy("capture_id")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
