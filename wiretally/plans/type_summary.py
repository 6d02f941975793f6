"""Reports per capture and packet type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions import size_text
from wiretally.operators.names import with_packet_name
from wiretally.operators.ordering import CHUNK_BITS
from wiretally.operators.stats import packet_type_stats, reversal_counts


def type_summary(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Which types arrived, how many, at which sizes, and how often they fell back."""
    return with_packet_name(packet_type_stats(packets, chunk_bits)).withColumn(
        "sizes", size_text(F.col("sizes"))
    )


def flashbacks(packets: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The types with reversals, by name, or by id when the catalog lacks them."""
    return with_packet_name(
        reversal_counts(packets, chunk_bits).where(F.col("backwards") > 0),
        default_to_id=True,
    )
