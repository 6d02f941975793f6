"""Running a stream over all files present and reading back what it wrote."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame

from wiretally.session import scratch_dir, short_listings
from wiretally.sources.files import resolve


def run_appending(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Append a stream's rows to Parquet, exactly once, then read them."""
    spark = stream.sparkSession
    root = path or scratch_dir(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
    )
    with short_listings(spark):
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def newest_batch(root: str) -> int | None:
    """Number of the newest result below ``root`` that was written to its end."""
    store, name = resolve(root)
    folders = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    done = [
        int(f.base_name.removeprefix("batch="))
        for f in folders
        if f.base_name.startswith("batch=")
        and store.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File
    ]
    return max(done, default=None)


def run_complete(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Keep the newest full result of an aggregate in Parquet, then read it.

    Each micro-batch writes its own folder, so a repeated batch replaces
    itself and a reader never sees a half-written result. Older results go once
    a newer one is whole. A restart without new data finds the last result.
    """
    spark = stream.sparkSession
    root = path or scratch_dir(spark, label)

    def keep(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        store, name = resolve(root)
        for old in store.get_file_info(fs.FileSelector(name)):
            number = old.base_name.removeprefix("batch=")
            if number != old.base_name and int(number) < batch_id:
                store.delete_dir(old.path)

    writer = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
    )
    with short_listings(spark):
        writer.start().awaitTermination()
    newest = newest_batch(root)
    if newest is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{root}/batch={newest}")
