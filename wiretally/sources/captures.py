"""Reading framed capture logs.

A capture is a folder ``capture_id=<id>`` of log segments, or a single log
file. A segment named ``segment-<n>.bin`` starts at record number ``n`` of its
capture; any other file starts at 0. The concatenated segments of a capture
are a plain log, since the format has neither header nor footer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.functions.header_arrays import (
    DECODED_COLUMNS,
    HEADER_FIELD_TYPES,
    decode_heads,
)
from wiretally.layout import HEADER_BYTES, LOG_FRAME_BYTES
from wiretally.sources.framing import frames, payload_array, record_batches

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
SEGMENT_NAME = r"segment-(\d+)\.bin$"
FOLDER_ID = r"/capture_id=([^/]+)/"
FILE_STEM = r"([^/]+?)(\.[^./]*)?$"

RAW_COLUMNS = [
    T.StructField("seq", T.LongType()),
    T.StructField("recv_mono", T.DoubleType()),
    T.StructField("size", T.IntegerType()),
]


def segment_start(path: Column) -> Column:
    """Record number a log file starts at."""
    digits = F.regexp_extract(path, SEGMENT_NAME, 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("bigint")).cast("bigint")


def open_files(reader, path: str, capture_id_type: str | None) -> DataFrame:
    """The log files under ``path`` with ``capture_id`` and ``segment``.

    With ``capture_id_type`` the ids come from ``capture_id=`` folders, as a
    partition column that prunes; without, every file is a capture of its own
    and its name is the id.
    """
    schema = FILE_SCHEMA + (f", capture_id {capture_id_type}" if capture_id_type else "")
    files = reader.format("binaryFile").schema(schema).load(path)
    if not capture_id_type:
        files = files.withColumn("capture_id", F.regexp_extract("path", FILE_STEM, 1))
    return files.withColumn("segment", segment_start(F.col("path")))


def capture_files(
    spark: SparkSession, path: str, capture_id_type: str | None = None
) -> DataFrame:
    """The listing of a log folder. Contents are not read, empty logs are left out."""
    return open_files(spark.read, path, capture_id_type).select(
        "capture_id", "segment", "path", "length", F.col("modificationTime").alias("modified_at")
    )


def listed_captures(
    spark: SparkSession, path: str, capture_id_type: str | None = None
) -> DataFrame:
    """Every capture with a log under ``path``, empty logs included.

    Scans skip empty files, so this starts from the file names Spark listed.
    """
    names = open_files(spark.read, path, capture_id_type).inputFiles()
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    if capture_id_type:
        capture_id = F.regexp_extract("path", FOLDER_ID, 1).cast(capture_id_type)
    else:
        capture_id = F.regexp_extract("path", FILE_STEM, 1)
    return listed.select(capture_id.alias("capture_id")).distinct()


def read_captures(
    spark: SparkSession, path: str, capture_id_type: str | None = None
) -> DataFrame:
    """``packets_raw`` of all logs under ``path``; a task frames whole files.

    Spark refuses files above 2 GB here; use
    :func:`wiretally.sources.splits.read_split_captures` for those. A cut or
    damaged record ends its file with one row that has ``error`` set and no
    payload; all records before it are read.
    """
    return frame_files(open_files(spark.read, path, capture_id_type))


def read_packets(
    spark: SparkSession, path: str, capture_id_type: str | None = None
) -> DataFrame:
    """``packets`` of all logs under ``path``, framed and decoded in one pass.

    Skips the way back through payload rows: only header columns leave the
    Python workers. Runts and damaged tails leave no row; ``capture_damage``
    reports the tails.
    """
    return frame_files(open_files(spark.read, path, capture_id_type), headers_only=True)


def damage_schema(capture_id: T.StructField) -> T.StructType:
    numbers = [T.StructField(n, T.LongType()) for n in ("segment", "record", "byte", "unread_bytes")]
    return T.StructType([capture_id, *numbers, T.StructField("problem", T.StringType())])


def frame_damage(files: DataFrame) -> DataFrame:
    """Where logs end before their file does, for a batch or stream of files.

    ``(capture_id, segment, record, byte, unread_bytes, problem)``: the number
    of the record that cannot be read, where it begins, and the bytes from
    there to the end of the file. Readers of packets alone have no row to put
    this in; run this beside them over the same files.
    """
    files = files.select("capture_id", "segment", "content")
    schema = damage_schema(files.schema["capture_id"])
    names = schema.fieldNames()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = memoryview(batch.column(2)[i].as_buffer())
                record = batch.column(1)[i].as_py()
                problem, end = None, 0
                if len(data):
                    for offsets, end, problem in record_batches(data, 0, len(data)):
                        record += len(offsets)
                if problem:
                    numbers = [record, end, len(data) - end]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, 1),
                            batch.column(1).slice(i, 1),
                            *[pa.array([x], pa.int64()) for x in numbers],
                            pa.array([problem]),
                        ],
                        names,
                    )

    return files.mapInArrow(find, schema)


def capture_damage(
    spark: SparkSession, path: str, capture_id_type: str | None = None
) -> DataFrame:
    """The damage report of all logs under ``path``; see ``frame_damage``."""
    return frame_damage(open_files(spark.read, path, capture_id_type))


def damage_in(packets_raw: DataFrame, files: DataFrame) -> DataFrame:
    """The damage report of logs already framed, from their error rows.

    For readers that keep those rows, ``read_captures`` and
    ``read_split_captures``; ``files`` is their listing.
    """
    errors = packets_raw.where("error IS NOT NULL").select(
        "capture_id",
        "segment",
        F.col("seq").alias("record"),
        F.regexp_extract("error", r"at byte (\d+)$", 1).cast("bigint").alias("byte"),
        F.regexp_extract("error", "^(.*) at byte", 1).alias("problem"),
    )
    lengths = files.select("capture_id", "segment", "length")
    return errors.join(lengths, ["capture_id", "segment"]).select(
        "capture_id",
        "segment",
        "record",
        "byte",
        (F.col("length") - F.col("byte")).alias("unread_bytes"),
        "problem",
    )


def raw_schema(capture_id: T.StructField, headers_only: bool) -> T.StructType:
    fields = [capture_id, T.StructField("segment", T.LongType()), *RAW_COLUMNS]
    if headers_only:
        return T.StructType([*fields, *HEADER_FIELD_TYPES])
    return T.StructType(
        [*fields, T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())]
    )


def frame_files(files: DataFrame, headers_only: bool = False) -> DataFrame:
    """Frame a batch or stream of files with capture_id, segment and content."""
    files = files.select("capture_id", "segment", "content")
    schema = raw_schema(files.schema["capture_id"], headers_only)

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                capture_id, segment = batch.column(0)[i], batch.column(1)[i]
                data = memoryview(batch.column(2)[i].as_buffer())
                yield from rows_of(
                    data, 0, len(data), capture_id, segment, segment.as_py(), headers_only
                )

    return files.mapInArrow(frame, schema)


def rows_of(
    data: memoryview,
    start: int,
    stop: int,
    capture_id: pa.Scalar,
    segment: pa.Scalar,
    seq: int,
    headers_only: bool,
    base: int = 0,
) -> Iterator[pa.RecordBatch]:
    """Output batches for the records that begin in ``[start, stop)``.

    ``base`` is where in its file ``data`` begins.
    """
    if len(data) == 0:
        return
    buffer = np.frombuffer(data, np.uint8)
    for offsets, end, problem in record_batches(data, start, stop):
        if len(offsets):
            framed = frames(buffer, offsets)
            sizes = framed["length"].astype(np.int32)
            numbers = np.arange(seq, seq + len(offsets), dtype=np.int64)
            times = np.ascontiguousarray(framed["recv_mono"])
            seq += len(offsets)
            if headers_only:
                valid = sizes >= HEADER_BYTES
                offsets, sizes = offsets[valid], sizes[valid]
                numbers, times = numbers[valid], times[valid]
                names = DECODED_COLUMNS
                body = decode_heads(buffer, offsets + LOG_FRAME_BYTES, sizes)
            else:
                names = ["payload", "error"]
                body = [payload_array(data, offsets, sizes), pa.nulls(len(offsets), pa.string())]
            n = len(offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(capture_id, n),
                    pa.repeat(segment, n),
                    pa.array(numbers),
                    pa.array(times),
                    pa.array(sizes),
                    *body,
                ],
                ["capture_id", "segment", "seq", "recv_mono", "size", *names],
            )
        if problem and not headers_only:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(capture_id, 1),
                    pa.repeat(segment, 1),
                    pa.array([seq], pa.int64()),
                    pa.nulls(1, pa.float64()),
                    pa.nulls(1, pa.int32()),
                    pa.nulls(1, pa.binary()),
                    pa.array([f"{problem} at byte {base + end}"]),
                ],
                ["capture_id", "segment", "seq", "recv_mono", "size", "payload", "error"],
            )
