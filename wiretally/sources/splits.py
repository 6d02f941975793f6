"""Reading one large capture log with many tasks.

A log has no sync marker, so a task that starts in the middle of a file cannot
know where the next record begins. But a record is at most 4108 bytes, so some
record begins within the first 4108 bytes of any range. Three Spark steps find
out where, exactly:

1. every range follows the records from each offset that could be its first
   record and keeps where that chain leaves the range; offsets inside a payload
   soon meet an impossible length and drop out, and chains that meet continue as
   one;
2. these rows are steps from range to range. Those that no step of the range
   before leads to go, which leaves about one a range. Joined with themselves
   the others become steps over 2, 4, 8, ... ranges, and as many joins as the
   number of ranges in the largest file has bits lead from offset 0 to the true
   first record of every range and its number;
3. every range is read from its true first record.

The joins are by a number of the file and offset, so the ranges of one file
spread over all tasks, and nothing about a file meets in one place. They never
broadcast: the steps lie on disk packed far smaller than in memory, so that
Spark would send tables to the driver that may not fit it.

Files are opened through ``pyarrow.fs``, on whatever shared storage it knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.layout import LOG_FRAME_BYTES, MAX_DATAGRAM_BYTES
from wiretally.session import shuffle_width, stored
from wiretally.sources.captures import raw_schema, rows_of
from wiretally.sources.files import resolve
from wiretally.sources.framing import record_batches

RANGE_BYTES = 128 << 20
MAX_RECORD_BYTES = LOG_FRAME_BYTES + MAX_DATAGRAM_BYTES


def read_range(path: str, start: int, stop: int) -> bytes:
    """File bytes ``[start, stop)``, fewer at the end of the file."""
    store, name = resolve(path)
    with store.open_input_file(name) as file:
        file.seek(start)
        return file.read(stop - start)


def follow(data: bytes, start: int, stop: int) -> tuple[int, int, str | None]:
    """Number of records that begin in ``[start, stop)``, where they end, what is wrong."""
    count, end, problem = 0, start, None
    for offsets, end, problem in record_batches(data, start, stop):
        count += len(offsets)
    return count, end, problem


def possible_entries(data: bytes, entries: int) -> list[int]:
    """The offsets below ``entries`` whose length, if they hold a whole frame, is one of a record."""
    head = np.frombuffer(data, np.uint8, min(entries + 3, len(data))).astype(np.uint32)
    framed = max(min(entries, len(data) - LOG_FRAME_BYTES + 1), 0)
    lengths = np.zeros(framed, np.uint32)
    for k in range(4):
        lengths |= head[k : k + framed] << np.uint32(8 * k)
    fits = np.flatnonzero((lengths > 0) & (lengths <= MAX_DATAGRAM_BYTES))
    return [*fits.tolist(), *range(framed, entries)]


def chains(data: bytes, span: int, entries: int) -> list[tuple[int, int | None, int]]:
    """Where the records from each possible entry lead.

    ``(entry, exit, records)`` with offsets into ``data``; records begin before
    ``span`` and ``exit`` is the first record at or after it. ``exit`` is None
    when the file ends inside the last record. The hindmost chain moves first,
    and chains that meet go on as one, so that no offset is looked at twice,
    whatever payloads look like, and only the place of each chain is held.
    """
    place = {entry: entry for entry in possible_entries(data, entries)}
    hindmost = list(place)
    steps = [0] * entries
    leads: list[tuple[int | None, int] | None] = [None] * entries
    meetings = []
    while hindmost:
        at = heappop(hindmost)
        chain = place.pop(at)
        # The last chain left has none to meet.
        count, end, problem = follow(data, at, at + 1 if hindmost else span)
        steps[chain] += count
        if problem:
            leads[chain] = None if problem == "bad length" else (None, steps[chain])
        elif end >= span:
            leads[chain] = (end, steps[chain])
        elif end in place:
            other = place[end]
            meetings.append((chain, other, steps[chain] - steps[other]))
        else:
            place[end] = chain
            heappush(hindmost, end)
    # A chain that others have met may itself have met another later on.
    for chain, other, more in reversed(meetings):
        lead = leads[other]
        leads[chain] = lead and (lead[0], lead[1] + more)
    return [(entry, *lead) for entry, lead in enumerate(leads) if lead]


def range_steps(files: DataFrame, range_bytes: int, tasks: int) -> DataFrame:
    """``(file, entry, exit, records)``: from a possible first record of a range to the next range's.

    Only exits inside the file count, and no range that ends its file is read.
    """
    ranges = (
        files.where(F.col("length") > range_bytes)
        .withColumn(
            "start",
            F.explode(F.sequence(F.lit(0), F.col("length") - 1 - range_bytes, F.lit(range_bytes))),
        )
        .select("file", "path", "length", "start")
        .repartition(tasks, "file", "start")
    )
    names = ["file", "entry", "exit", "records"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                data = read_range(row["path"], start, start + range_bytes + MAX_RECORD_BYTES)
                span = min(range_bytes, len(data))
                entries = 1 if start == 0 else min(MAX_RECORD_BYTES, span)
                leads = [
                    (start + entry, start + leave, records)
                    for entry, leave, records in chains(data, span, entries)
                    if leave is not None and start + leave < row["length"]
                ]
                if leads:
                    columns = [pa.array(c, pa.int64()) for c in zip(*leads)]
                    file = pa.array([row["file"]] * len(leads), pa.int64())
                    yield pa.RecordBatch.from_arrays([file, *columns], names)

    return ranges.mapInArrow(find, "file long, entry long, exit long, records long")


def reached_steps(steps: DataFrame) -> DataFrame:
    """The steps from the beginning of a file, and from where a step of the range before leads."""
    exits = steps.select("file", F.col("exit").alias("entry")).distinct().hint("merge")
    onward = steps.join(exits, ["file", "entry"], "left_semi")
    return steps.where("entry = 0").unionByName(onward)


def first_records(files: DataFrame, range_bytes: int, most: int, tasks: int) -> DataFrame:
    """``files`` with ``entry`` and ``seq``: a row per range in which a record begins.

    ``file`` numbers the files. ``most`` is the largest number of ranges of a file. A range after damage
    has no row; the one with the damage has, since it must be read up to there.
    """
    reached = files.withColumn("entry", F.lit(0).cast("bigint")).withColumn("seq", F.col("segment"))
    if most > 1:
        steps = stored(range_steps(files, range_bytes, tasks), "range-steps")
        steps = stored(reached_steps(steps), "range-steps")
    known = 1
    while known < most:
        here = F.struct("entry", "seq")
        there = F.struct(F.col("exit").alias("entry"), (F.col("seq") + F.col("records")).alias("seq"))
        both = F.when(F.col("exit").isNull(), F.array(here)).otherwise(F.array(here, there))
        reached = (
            reached.join(steps.hint("merge"), ["file", "entry"], "left")
            .select(*files.columns, F.explode(both).alias("_place"))
            .select(*files.columns, "_place.entry", "_place.seq")
        )
        known *= 2
        if known < most:
            onward = steps.select(
                "file",
                F.col("entry").alias("exit"),
                F.col("exit").alias("_exit"),
                F.col("records").alias("_records"),
            )
            steps = stored(
                steps.join(onward.hint("merge"), ["file", "exit"]).select(
                    "file",
                    "entry",
                    F.col("_exit").alias("exit"),
                    (F.col("records") + F.col("_records")).alias("records"),
                ),
                "range-steps",
            )
    return reached


def read_split_captures(
    files: DataFrame, range_bytes: int = RANGE_BYTES, headers_only: bool = False
) -> DataFrame:
    """``packets_raw`` (or ``packets``) of log files of any size.

    ``files`` is a listing as from :func:`~wiretally.sources.captures.capture_files`.
    Files longer than a range are scanned for entry points at once, when this
    is called; what is found lies below ``spark.checkpoint.dir``.
    """
    capture_id = files.schema["capture_id"]
    tasks = shuffle_width(files.sparkSession)
    sized = files.where("length > 0").select(
        "capture_id", "segment", "path", "length", F.monotonically_increasing_id().alias("file")
    )
    sized = stored(sized, "range-files")
    most = sized.agg(F.max(F.ceil(F.col("length") / F.lit(range_bytes)))).first()[0] or 0
    reads = first_records(sized, range_bytes, most, tasks)
    reads = reads.withColumn("start", F.col("entry") - F.pmod("entry", F.lit(range_bytes)))
    reads = reads.drop("length", "file").repartition(tasks, "path", "start")
    schema = raw_schema(capture_id, headers_only)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                entry, stop = row["entry"], row["start"] + range_bytes
                data = memoryview(read_range(row["path"], entry, stop + MAX_RECORD_BYTES))
                yield from rows_of(
                    data,
                    0,
                    min(stop - entry, len(data)),
                    batch.column("capture_id")[i],
                    batch.column("segment")[i],
                    row["seq"],
                    headers_only,
                    base=entry,
                )

    return reads.mapInArrow(read, schema)
