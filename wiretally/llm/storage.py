"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wiretally.session import scratch_dir, shuffles_dropped


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: later steps never repeat its work.

    The table lies below ``spark.checkpoint.dir``, so that it outlives the
    executors which wrote it. The owner of that folder clears it. What was
    shuffled for it goes as soon as it is written.
    """
    path = f"{scratch_dir(df.sparkSession, label)}/table"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
