"""Intermediate tables leave nothing behind but themselves."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wiretally.llm.storage import durable
from wiretally.session import SHUFFLE_CLEANUP, stored


def shuffle_files(spark):
    """The data files of shuffles that the session's own executor holds."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = env.blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


@pytest.mark.parametrize("keep", [durable, stored])
def test_a_written_table_drops_its_shuffles(spark, keep):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 1000)
    sums = rows.groupBy("k").agg(F.sum("id").alias("total")).join(rows, "k")
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    table = keep(sums, "sums")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert table.count() == 20_000
    assert keep(sums, "again").exceptAll(table).isEmpty()
