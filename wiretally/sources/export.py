"""Writing capture logs: the framed format, byte for byte."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wiretally.functions.header_arrays import binary_parts
from wiretally.layout import LOG_FRAME_BYTES, LOG_FRAME_DTYPE, MAX_DATAGRAM_BYTES
from wiretally.operators.headers import datagrams
from wiretally.sources.files import resolve

# 2**17 records of at most 4108 bytes stay below 540 MB, so that one task can
# read a segment back as one file; at the usual kilobyte it is 128 MB.
SEGMENT_BITS = 17
COMPARE_BYTES = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    segments: int


class CaptureLogWriter(DataSourceArrowWriter):
    """Writes rows that arrive clustered by capture and segment, in order.

    A segment appears under its final name only when complete. Its content
    depends on its rows alone, so a task that runs twice, after a lost
    executor or as a speculative copy, puts the same file in the same place. A
    segment that is there with other content is left alone and the export fails.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = resolve(self.path)
        open_key, out, segments = None, None, 0
        staged = final = ""
        for batch in iterator:
            cuts = run_bounds(batch, ["capture_id", "segment"])
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(batch.column(c)[lo].as_py() for c in ("capture_id", "segment"))
                if key != open_key:
                    if out is not None:
                        out.close()
                        publish(store, staged, final)
                    open_key = key
                    folder = f"{root}/capture_id={open_key[0]}"
                    store.create_dir(folder)
                    name = f"segment-{open_key[1]:020d}.bin"
                    final = f"{folder}/{name}"
                    staged = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(staged)
                    segments += 1
                out.write(framed(batch.slice(lo, hi - lo)))
        if out is not None:
            out.close()
            publish(store, staged, final)
        return Written(segments)


class CaptureLogSink(DataSource):
    """``df.write.format("capture_log")``."""

    @classmethod
    def name(cls) -> str:
        return "capture_log"

    def writer(self, schema, overwrite: bool) -> CaptureLogWriter:
        if overwrite:
            raise ValueError("capture logs are only ever appended to")
        return CaptureLogWriter(self.options["path"])


def run_bounds(batch: pa.RecordBatch, names: list[str]) -> list[int]:
    """Where runs of rows with equal values begin, and the number of rows."""
    n = len(batch)
    if n == 0:
        return [0]
    changed = np.zeros(n - 1, bool)
    for name in names:
        column = batch.column(name)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        changed |= differs.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), n]


def publish(store: fs.FileSystem, staged: str, final: str) -> None:
    """Give a finished segment its name, unless another content has it."""
    there = store.get_file_info(final)
    if there.type == fs.FileType.NotFound:
        store.move(staged, final)
        return
    same = there.size == store.get_file_info(staged).size and equal_content(store, staged, final)
    store.delete_file(staged)
    if not same:
        raise ValueError(f"{final} exists with other records; export to a new folder")


def equal_content(store: fs.FileSystem, one: str, other: str) -> bool:
    with store.open_input_stream(one) as a, store.open_input_stream(other) as b:
        while True:
            left, right = a.read(COMPARE_BYTES), b.read(COMPARE_BYTES)
            if left != right:
                return False
            if not left:
                return True


def framed(batch: pa.RecordBatch) -> bytes:
    """The log bytes of a batch: each payload behind its frame."""
    _, _, sizes = binary_parts(batch.column("payload"))
    if len(sizes) and sizes.max() > MAX_DATAGRAM_BYTES:
        raise ValueError(f"a log holds no datagram above {MAX_DATAGRAM_BYTES} bytes")
    frame = np.empty(len(batch), LOG_FRAME_DTYPE)
    frame["length"] = sizes
    frame["recv_mono"] = batch.column("recv_mono").to_numpy()
    heads = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(LOG_FRAME_BYTES), len(batch), [None, pa.py_buffer(frame.tobytes())]
    )
    wide = pa.large_binary()
    payloads = batch.column("payload").cast(wide)
    joined = pc.binary_join_element_wise(heads.cast(wide), payloads, pa.scalar(b"", wide))
    data, starts, lengths = binary_parts(joined)
    return bytes(data[int(starts[0]) : int(starts[-1] + lengths[-1])]) if len(batch) else b""


def write_captures(packets_raw: DataFrame, path: str, segment_bits: int = SEGMENT_BITS) -> None:
    """Export datagrams as log segments of ``2**segment_bits`` record numbers.

    Rows shuffle by capture and segment, so a hot capture spreads over many
    tasks. A segment is named after the number its first record gets on
    reading; numbers stay as they are when a capture counts from 0 without gaps,
    and keep their order otherwise.
    """
    spark = packets_raw.sparkSession
    spark.dataSource.register(CaptureLogSink)
    (
        datagrams(packets_raw)
        .withColumn("segment", F.shiftleft(F.shiftright("seq", segment_bits), segment_bits))
        .select("capture_id", "segment", "seq", "recv_mono", "payload")
        .repartition("capture_id", "segment")
        .sortWithinPartitions("capture_id", "segment", "seq")
        .write.format("capture_log")
        .option("path", path)
        .mode("append")
        .save()
    )
