"""Cutting a run of capture-log bytes into records, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from struct import Struct

import numpy as np
import pyarrow as pa

from wiretally.functions.header_arrays import gather
from wiretally.layout import LOG_FRAME_BYTES, LOG_FRAME_DTYPE, MAX_DATAGRAM_BYTES

BATCH_RECORDS = 1 << 16
BATCH_BYTES = 32 << 20


def record_batches(
    data, start: int, stop: int
) -> Iterator[tuple[np.ndarray, int, str | None]]:
    """Offsets of the records that begin in ``[start, stop)``.

    Yields ``(offsets, end, problem)`` per batch. A problem comes last, with
    the offset it was met at as ``end``. A log never holds an empty datagram
    nor one above the receive limit, so any other length means the bytes are
    not a record.
    """
    length_at = Struct("<I").unpack_from
    total = len(data)
    last_frame = total - LOG_FRAME_BYTES
    at, first, offsets = start, start, []
    problem = None
    while at < stop:
        if at > last_frame:
            problem = "cut record"
            break
        (length,) = length_at(data, at)
        if not 0 < length <= MAX_DATAGRAM_BYTES:
            problem = "bad length"
            break
        end = at + LOG_FRAME_BYTES + length
        if end > total:
            problem = "cut record"
            break
        offsets.append(at)
        at = end
        if len(offsets) == BATCH_RECORDS or at - first >= BATCH_BYTES:
            yield np.array(offsets, np.int64), at, None
            first, offsets = at, []
    if offsets or problem:
        yield np.array(offsets, np.int64), at, problem


def frames(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The frames at these offsets: payload length and receive time."""
    return gather(buffer, offsets, LOG_FRAME_DTYPE)


def payload_array(data: memoryview, offsets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The payloads of records that follow one another, copied once."""
    first, end = int(offsets[0]), int(offsets[-1]) + LOG_FRAME_BYTES + int(sizes[-1])
    inside = np.ones(end - first, bool)
    for k in range(LOG_FRAME_BYTES):
        inside[offsets - first + k] = False
    payloads = np.frombuffer(data, np.uint8)[first:end][inside]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets), [None, pa.py_buffer(ends), pa.py_buffer(payloads)]
    )
