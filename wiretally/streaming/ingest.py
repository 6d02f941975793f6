"""Live input: capture segments as a collector lands them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wiretally.sources.captures import frame_damage, frame_files, open_files

# Bounds a micro-batch, and with it the work per trigger after a backlog.
FILES_PER_TRIGGER = 1000


def stream_captures(
    spark: SparkSession,
    landing_dir: str,
    capture_id_type: str | None = None,
    files_per_trigger: int = FILES_PER_TRIGGER,
    headers_only: bool = False,
) -> DataFrame:
    """A stream of ``packets_raw``, or of ``packets`` with ``headers_only``.

    Each closed segment that appears under ``landing_dir`` is read once, oldest
    first.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return frame_files(open_files(reader, landing_dir, capture_id_type), headers_only)


def stream_damage(
    spark: SparkSession,
    landing_dir: str,
    capture_id_type: str | None = None,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """The damage report of segments as they land, to run beside ``stream_captures``."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return frame_damage(open_files(reader, landing_dir, capture_id_type))


def stream_from_archive(
    spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """A stream of the datagrams in a Parquet archive, as its files appear."""
    schema = spark.read.parquet(path).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
