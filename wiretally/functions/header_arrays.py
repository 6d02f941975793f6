"""Header decode over a whole Arrow batch at once, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from wiretally.layout import (
    EVENT_PACKET_BYTES,
    EVENT_PACKET_ID,
    HEADER_BYTES,
    HEADER_DTYPE,
    HEADER_FIELDS,
    HEADER_LAYOUT,
)

_ARROW_TYPES = {
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.FloatType(): pa.float32(),
    T.DecimalType(20, 0): pa.decimal128(20, 0),
}

HEADER_FIELD_TYPES = [T.StructField(n, t) for n, _, _, t in HEADER_LAYOUT] + [
    T.StructField("event_code", T.StringType())
]
DECODED_COLUMNS = [*HEADER_FIELDS, "event_code"]


def gather(buffer: np.ndarray, starts: np.ndarray, kind: np.dtype) -> np.ndarray:
    """One value of type ``kind`` from each start, aligned or not."""
    anywhere = np.ndarray(max(len(buffer) - kind.itemsize + 1, 0), kind, buffer, strides=(1,))
    return anywhere[starts]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte buffer, value starts and value sizes of a BINARY column, uncopied."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8), ends[:-1].astype(np.int64), np.diff(ends)


def decode_heads(
    buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> list[pa.Array]:
    """The header columns and the event code of valid packets.

    ``sizes`` are the true packet sizes and decide whether a code is present.
    """
    header = gather(buffer, starts, HEADER_DTYPE)
    columns = [
        pa.array(np.ascontiguousarray(header[name])).cast(_ARROW_TYPES[spark_type])
        for name, _, _, spark_type in HEADER_LAYOUT
    ]
    events = np.flatnonzero(
        (header["packet_id"] == EVENT_PACKET_ID) & (sizes >= EVENT_PACKET_BYTES)
    )
    codes = gather(buffer, starts[events] + HEADER_BYTES, np.dtype("<u4"))
    distinct, which = np.unique(codes, return_inverse=True)
    texts = [c.tobytes().decode("ascii", "replace") for c in distinct]
    slot = np.full(len(header), -1, np.int64)
    slot[events] = which
    taken = pa.array(slot, mask=slot < 0)
    return [*columns, pa.array(texts, pa.string()).take(taken)]
