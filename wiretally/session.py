"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def build_session(app: str = "wiretally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(STATE_STORE, ROCKSDB_PROVIDER)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, so window starts do not depend on the host."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Keep stream state in RocksDB, for sessions that ``build_session`` did not make."""
    spark.conf.set(STATE_STORE, ROCKSDB_PROVIDER)
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for rows that are few now and many after they are opened.

    Spark would merge such small partitions at run time; a number keeps them.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session
    may leave it unset: there all executors share the machine's own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/wiretally-{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"spark-wiretally-{label}-")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes within drop their shuffle files as they end.

    Otherwise those stay until the driver happens to collect its garbage, and
    the files of a long chain of intermediate tables add up.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def short_listings(spark: SparkSession) -> Iterator[None]:
    """Streams that run within look up a micro-batch's files in a few tasks a core.

    Spark otherwise runs a task for every file, up to 10,000, once a micro-batch
    and once more at a restart; each takes longer to schedule than to run.
    """
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, for what several steps need."""
    path = f"{scratch_dir(df.sparkSession, label)}/table"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
