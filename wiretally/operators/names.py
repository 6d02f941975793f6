"""The packet-type catalog and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.layout import PACKET_NAMES, UNKNOWN_NAME


def packet_types(spark: SparkSession) -> DataFrame:
    """The catalog, one row per packet type."""
    rows = ", ".join(f"({i}, '{name}')" for i, name in PACKET_NAMES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(packet_id, packet_name)")


def packet_name(packet_id: Column, default: Column) -> Column:
    """Name of a packet type, or ``default`` outside the catalog.

    The catalog has 14 fixed entries, so it travels as a literal map: the
    lookup is an expression and needs no join.
    """
    catalog = F.create_map(*[F.lit(x) for entry in PACKET_NAMES.items() for x in entry])
    return F.coalesce(F.try_element_at(catalog, packet_id), default)


def with_packet_name(df: DataFrame, default_to_id: bool = False) -> DataFrame:
    """Add ``packet_name``; types outside the catalog get UNKNOWN or their id."""
    packet_id = F.col("packet_id")
    default = packet_id.cast("string") if default_to_id else F.lit(UNKNOWN_NAME)
    return df.withColumn("packet_name", packet_name(packet_id, default))


def types_seen(packets: DataFrame) -> DataFrame:
    """The packet types that occur in each capture."""
    return packets.select("capture_id", "packet_id").distinct()


def missing_types(packets: DataFrame) -> DataFrame:
    """Catalog types that never occur in a capture with valid packets.

    A capture has at most 256 types (the id is one byte), so its set of types
    fits one row and the difference needs no join.
    """
    catalog = F.array(*[F.lit(i) for i in PACKET_NAMES])
    absent = (
        types_seen(packets)
        .groupBy("capture_id")
        .agg(F.collect_list("packet_id").alias("_seen"))
        .select("capture_id", F.explode(F.array_except(catalog, "_seen")).alias("packet_id"))
    )
    return with_packet_name(absent)
