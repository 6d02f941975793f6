"""From raw datagrams to decoded packets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.functions import is_datagram, is_valid, packet_size
from wiretally.functions.header_arrays import (
    DECODED_COLUMNS,
    HEADER_FIELD_TYPES,
    binary_parts,
    decode_heads,
)
from wiretally.layout import EVENT_PACKET_BYTES


def datagrams(raw: DataFrame) -> DataFrame:
    """Every datagram that is not empty, as received.

    Adds ``size``, so that totals and counts never have to read payloads again.
    """
    sized = raw.withColumn("size", packet_size(F.col("payload")))
    return sized.where(is_datagram(F.col("size")))


def decode_headers(packets_raw: DataFrame) -> DataFrame:
    """Replace ``payload`` by the header columns and the event code.

    Runts go first, on the JVM side. Only the bytes that can matter, header
    and code, cross to the Python workers; the rest of the payload does not.
    """
    valid = datagrams(packets_raw).where(is_valid(F.col("size")))
    heads = valid.withColumn("payload", F.substring("payload", 1, EVENT_PACKET_BYTES))
    kept = [f for f in heads.schema.fields if f.name != "payload"]
    names = [f.name for f in kept]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            buffer, starts, _ = binary_parts(batch.column("payload"))
            sizes = batch.column("size").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *decode_heads(buffer, starts, sizes)],
                [*names, *DECODED_COLUMNS],
            )

    return heads.mapInArrow(decode, T.StructType([*kept, *HEADER_FIELD_TYPES]))
